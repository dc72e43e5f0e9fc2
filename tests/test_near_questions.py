"""Near-duplicate questions against all pairs."""

import random
from itertools import combinations

import pytest

from tallyloom.operators import near_questions


def bigrams(stem, q):
    s = "".join((stem or "").split()).lower()
    return {s[i : i + q] for i in range(max(1, len(s) - q + 1))} if s else set()


def plainly(rows, percent, q):
    norm = {i: "".join((s or "").split()).lower() for i, s in rows}
    first = {}
    for i, s in norm.items():
        first[s] = min(i, first.get(s, i))
    links = dict.fromkeys(first.values(), 0)
    for (a, i), (b, j) in combinations(first.items(), 2):
        x, y = bigrams(a, q), bigrams(b, q)
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            links[i], links[j] = links[i] + 1, links[j] + 1
    return sorted((i, first[s], links[first[s]]) for i, s in norm.items())


def stems(rng, n, alphabet):
    out = []
    while len(out) < n:
        base = [rng.choice(alphabet) for _ in range(rng.choice((1, 2, 6, 20, 40)))]
        for _ in range(rng.randint(1, 4)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(alphabet)
            out.append("".join(copy))
    return out[:n]


@pytest.mark.parametrize(("percent", "q", "alphabet"), [(60, 2, "abcdefgh 漢字É"), (80, 2, "abc"), (80, 3, "abcdef"), (100, 2, "ab "), (34, 2, "abcdefghij")])
def test_near_questions_equal_all_pairs(spark, percent, q, alphabet):
    rows = list(enumerate(stems(random.Random(percent + q), 250, alphabet)))
    rows += [(900, None), (901, ""), (902, " \t"), (903, "x"), (904, "X"), (905, rows[3][1]), (906, rows[3][1].upper())]
    frame = spark.createDataFrame([(*r, "g", 1) for r in rows], "id long, stem string, gram string, size int")
    got = near_questions.near_questions(frame, percent, q).collect()
    assert sorted((r.id, r.class_id, r.links) for r in got) == plainly(rows, percent, q)


def test_common_grams_bring_few_pairs(spark):
    """A start that all stems share is in no prefix; candidates grow with the near pairs, not with the square of the stems."""
    rng = random.Random(5)
    counts = []
    for n in (400, 1600):
        rows = [(i, "which of these statements is right " + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60))) for i in range(n)]
        rows += [(n + i, rows[i][1] + "z") for i in range(0, n, 4)]
        frame = spark.createDataFrame(rows, "id long, stem string")
        sets = near_questions.keyed(frame).select(near_questions.F.col("id").alias("class_id"), near_questions.gram_set(near_questions.F.col("stem"), 4).alias("grams"))
        counts.append(near_questions.candidates(near_questions.coded(sets), 80).count())
        assert near_questions.similar_classes(frame, 80, 4).count() == n // 4
    assert counts[0] <= 2 * 100 and counts[1] <= 2 * 400


def test_shared_grams_are_not_shuffled(spark):
    """Texts of one small vocabulary share grams in every prefix; what is shuffled is that of texts and sketches, not a row for each gram that two texts share."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(150)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(100, 300)))) for i in range(150)]
    rows += [(1000 + i, rows[i][1] + " z") for i in range(0, 150, 10)]
    frame = spark.createDataFrame(rows, "id long, stem string")
    shuffled = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()  # noqa: E731, SLF001
    before = shuffled()
    found = near_questions.similar_classes(frame, 60, 5).collect()
    assert sorted(tuple(sorted((r.a, r.b))) for r in found) == [(i, 1000 + i) for i in range(0, 150, 10)]
    assert shuffled() - before < 4 * sum(len(text) for _, text in rows)


def test_no_rows_and_bad_similarity(spark):
    empty = spark.createDataFrame([], "id long, stem string")
    assert near_questions.near_questions(empty).count() == 0
    with pytest.raises(ValueError):
        near_questions.similar_classes(empty, 0)


def test_a_sketch_goes_to_few_tiles_however_many_sketches(spark, monkeypatch):
    """Tiles are cut by bytes, not by a number of rows, so small sketches meet in few tiles and large ones in small ones."""
    rng = random.Random(5)
    sketches = [(k + 1, 100 + k // 100, bytes(rng.randrange(256) for _ in range(64 if k < 15_000 else 256))) for k in range(20_000)]
    placed = spark.createDataFrame([(k, *row) for k, row in enumerate(sketches)], "class_id long, place long, size int, bits binary")
    seen = {}
    kept = near_questions.materialize
    monkeypatch.setattr(near_questions, "materialize", lambda df, name: seen.setdefault(name, kept(df, name)))
    monkeypatch.setattr(near_questions, "TILES", 1)
    near_questions.place_pairs(placed, 60)
    assert seen["tile_pairs"].count() == 1  # all fit into one tile of TILE_BYTES
    seen.clear()
    monkeypatch.setattr(near_questions, "TILE_BYTES", 1 << 20)
    near_questions.place_pairs(placed, 60)
    sizes = [r[0] for r in seen["tiles"].groupBy("tile").agg(near_questions.F.sum("bytes")).collect()]
    assert len(sizes) == 4 and max(sizes) <= (1 << 20) + 256 * (256 + near_questions.ROW_BYTES)
