"""SimHash near-duplicates, line dedup and decontamination against brute force."""

import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyloom.llm import common, components, decontaminate, line_dedup, simhash

WORDS = [f"w{i}" for i in range(400)]


def make(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, bits):
    root = {d: d for d, _ in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, p) in enumerate(prints):
        for b, q in prints[:i]:
            if (p ^ q).bit_count() <= bits:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d, _ in prints}


def near_texts(rng, n):
    out = []
    for _ in range(n):
        base = [rng.choice(WORDS) for _ in range(rng.choice((3, 30, 200)))]
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 3)):
            copy = list(base)
            copy[rng.randrange(len(copy))] = rng.choice(WORDS).upper()
            out.append("\t ".join(copy))
    return out


@pytest.mark.parametrize("bits", [4, 8])
def test_simhash_equals_brute_force(spark, bits):
    texts = [*near_texts(random.Random(bits), 60), None, "", " \n", "Ünï côde x y z", "a", "A", "x " * 70_000]
    rows = list(enumerate(texts))
    got = simhash.near_duplicates(make(spark, rows), bits).collect()
    prints = [(d, brute_print(t)) for d, t in rows]
    want = brute_components(prints, bits)
    assert {r.doc_id: r.fp % (1 << 64) for r in got} == dict(prints)
    assert {r.doc_id: r.component_id for r in got} == want
    assert len(set(want.values())) < len(rows)


def test_pairs_of_random_fingerprints(spark):
    rng = random.Random(9)
    prints = set()
    for _ in range(150):
        base = rng.getrandbits(64)
        prints |= {base, *[base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))) for _ in range(3)]}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    nodes = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    got = {(r.u, r.v) for r in simhash.links(nodes).distinct().collect()}
    ordered = sorted(prints, key=signed)
    assert got == {(signed(a), signed(b)) for i, a in enumerate(ordered) for b in ordered[i + 1 :] if (a ^ b).bit_count() <= 4}


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_trees_lose_no_pair_at_any_depth(spark, monkeypatch, levels):
    rng, prints = random.Random(levels), set()
    for _ in range(100):
        base = rng.getrandbits(64)
        prints |= {base, *[base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))) for _ in range(4)]}
    monkeypatch.setattr(simhash, "depth_for", lambda n: levels)
    nodes = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")
    got = {(r.u, r.v) for r in simhash.links(nodes).distinct().collect()}
    assert got == {tuple(sorted((simhash._signed(a), simhash._signed(b)))) for a, b in itertools.combinations(prints, 2) if (a ^ b).bit_count() <= 4}


def test_simhash_ids(spark):
    got = simhash.near_duplicates(make(spark, [(7, "a b c d e"), (7, "a b c d e"), (None, "a b c d e"), (None, "q r s t u v")])).collect()
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id) == [(7, 7), (7, 7)]
    assert {r.component_id for r in got if r.doc_id is None} == {7, None}
    assert simhash.near_duplicates(make(spark, [])).count() == 0


def test_long_chain_is_one_component(spark):
    edges = spark.range(300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert {r.root for r in components.connected_components(edges).collect()} == {0}


def distance(a, b):
    """Edit distance of word sequences."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        before, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], min(before + (x != y), row[j] + 1, row[j + 1] + 1)
    return row[-1]


def brute_lines(spark, rows, edits):
    """Dropped line numbers by (id, text): every line against all earlier ones."""
    docs = make(spark, rows)
    hashes = {(r.doc_id, r.text): r.ra for r in docs.select("doc_id", "text", *[c.alias(n) for n, c in line_dedup.row_names(docs).items()]).collect()}
    order = lambda k: (0, hashes[k]) if k[0] is None else (1, k[0], hashes[k] % (1 << 31))
    seen, dropped = [], {}
    for d, t in sorted({r for r in rows if r[1] is not None}, key=order):
        for i, line in enumerate(t.split("\n")):
            line = line.strip(" \t\n\x0b\x0c\r")
            if not line:
                continue
            words = re.split("[\\x20\\x09-\\x0D]+", line)
            near = lambda w: distance(words, w) <= min(edits, min(len(words), len(w)) // 5)  # noqa: B023, E731
            if any(line == other or near(w) for other, w in seen):
                dropped.setdefault((d, t), []).append(i)
            seen.append((line, words))
    return dropped


@pytest.mark.parametrize("edits", [1, 2])
def test_line_dedup_equals_brute_force(spark, edits):
    rng, lines = random.Random(5), []
    for _ in range(40):
        base = [rng.choice(WORDS[:60]) for _ in range(rng.choice((1, 4, 5, 6, 9, 10, 12, 25)))]
        lines.append(base)
        for _ in range(rng.randint(0, 3)):
            copy = list(base)
            for _ in range(rng.randint(1, 3)):
                at, kind = rng.randrange(len(copy) + 1), rng.randrange(4)
                copy[at : at + (kind < 2)] = [rng.choice(WORDS)] if kind in (0, 2) else []
            lines.append(copy or ["z"])
    rng.shuffle(lines)
    texts = ["\n".join(" ".join(x) for x in lines[i : i + 4]) for i in range(0, len(lines), 4)]
    same = " ".join(lines[1])
    rows = [*enumerate(texts), (900, None), (901, ""), (902, "\n\n"), (903, " " + " ".join(lines[0]) + "\t"), (None, "the only line of this text")]
    # null and repeated ids with texts that differ, and rows that are equal
    rows += [(None, "other\nUNIQUE LINE"), (5, f"{same}\nKEEP ME"), (5, "w\nKEEP ME TOO"), (5, "w\nKEEP ME TOO"), (None, "w\nx y z"), (None, None), (7, f"x\n{same}"), (7, f"y\n{same}\nx"), (-(1 << 63), "w\nlast"), ((1 << 63) - 1, "w\nfirst")]
    got = line_dedup.dedup_lines(make(spark, rows), edits).collect()
    want = brute_lines(spark, rows, edits)
    kept = lambda t, gone: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)
    expected = [(d, kept(t, want.get((d, t), [])), want.get((d, t), [])) for d, t in rows]
    assert sorted(((r.doc_id, r.text, r.dropped_lines) for r in got), key=str) == sorted(expected, key=str)
    assert len(want) > 20 and any("UNIQUE LINE" in (r.text or "") for r in got)


def test_line_dedup_passes_other_columns(spark):
    docs = make(spark, [(1, "x y"), (2, "x y\nz")]).selectExpr("*", "1 AS _doc", "2 AS place", "3 AS dropped_lines", "4 AS a", "5 AS line")
    got = line_dedup.dedup_lines(docs)
    assert got.columns == ["doc_id", "text", "_doc", "place", "a", "line", "dropped_lines"]
    assert {r.doc_id: (r.text, r.dropped_lines, r.place) for r in got.collect()} == {1: ("x y", [], 2), 2: ("z", [0], 2)}
    assert line_dedup.dedup_lines(docs.where("false")).count() == 0


def brute_leaks(rows, items):
    out = set()
    for d, text in rows:
        w = decontaminate.tokens(text)
        for k, item in items:
            x = decontaminate.tokens(item)
            for shift in range(-len(x) + 1, len(w)):
                lo, hi = max(0, -shift), min(len(x), len(w) - shift)
                if brute_stretch((w[lo + shift : hi + shift] == x[lo:hi]).tolist()) >= min(13, len(x)):
                    out.add((d, k))
    return out


def test_decontamination_finds_planted_and_nothing_else(spark):
    rng = random.Random(1)
    draw = lambda n: [rng.choice(WORDS) for _ in range(n)]
    items = [(k, draw(n)) for k, n in enumerate((8, 12, 13, 20, 30, 60, 3, 1))]
    rows, planted = [], set()
    for d in range(60):
        k, item = items[d % 6]
        passage = list(item[:40])
        if len(item) >= 20 and d % 3 == 0:  # one replaced word in twelve
            for at in range(5, len(passage), 12):
                passage[at] = "other"
        body = draw(rng.choice((0, 5, 200)))
        at = rng.randint(0, len(body))
        leak = d % 4 != 3
        rows.append((d, " ".join(body[:at] + (passage if leak else []) + body[at:]).title()))
        planted |= {(d, k)} if leak else set()
    items[7] = (7, ["alone"])
    rows += [(100, None), (101, ""), (102, " ".join(draw(70_000))), (103, " ".join(items[6][1])), (104, "stands Alone."), (105, " ".join(items[5][1] * 2)), (106, " ".join(items[5][1] * 2))]
    planted |= {(103, 6), (104, 7), (105, 5), (106, 5)}
    texts = [(k, " ".join(w)) for k, w in items]
    bench = spark.createDataFrame([*texts, (50, None), (None, "a b c d e f g h i j k l m n")], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(make(spark, rows), bench).collect()}
    brute = brute_leaks([r for r in rows if r[0] != 102], texts)
    assert planted <= found and {f for f in found if f[0] != 102} == brute


def brute_stretch(same):
    """Length of the longest stretch of which four fifths match, by trying all."""
    return max((j - i for i in range(len(same)) for j in range(i + 1, len(same) + 1) if 5 * sum(same[i:j]) >= 4 * (j - i)), default=0)


def test_stretch_is_reported_in_full(spark):
    """A long overlap with a gap that no seed meets is one stretch; 13 words stay found before many that are half replaced."""
    item = [f"i{k}" for k in range(240)]
    gap = item[:100] + ["other"] * 25 + item[125:]
    half = item[:13] + [w for k in range(14) for w in ("x", "y", *item[15 + 9 * k : 22 + 9 * k])]
    rows = [(1, " ".join(["before"] * 90 + gap + ["after"] * 90)), (2, " ".join(half)), (3, " ".join(["before"] * 9 + item[:30] + ["x"] * 6 + ["after"] * 90))]
    found = decontaminate.leaks(make(spark, rows), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert {r.doc_id: (r.overlap, r.matches) for r in found if r.doc_id != 2} == {1: (240, 215), 3: (37, 30)}
    same = [a == b for a, b in zip(half, item, strict=False)]
    assert {r.overlap for r in found if r.doc_id == 2} == {brute_stretch(same)}


def test_longest_stretch_equals_brute_force():
    rng = random.Random(4)
    for _ in range(300):
        same = [rng.random() < rng.choice((0.5, 0.8, 0.95)) for _ in range(rng.randint(0, 40))]
        length, matches = decontaminate.best_stretch(np.array(same, dtype=bool))
        assert length == brute_stretch(same) and 5 * matches >= 4 * length


@pytest.mark.parametrize("n", range(1, 26))
def test_seeds_meet_every_way_to_replace_words(n):
    masks = [(sum(1 << i for i, kept in enumerate(m) if kept == "1"), len(m)) for m in decontaminate.item_masks(n)]
    for gone in itertools.combinations(range(n), n // 5):
        same = (1 << n) - 1 - sum(1 << i for i in gone)
        assert any((same >> at) & m == m for m, span in masks for at in range(n - span + 1)), gone


def test_decontamination_finds_all_with_replaced_words(spark):
    """Words replaced at random up to the similarity, without reading the operator's own stretches."""
    rng, items, rows = random.Random(8), [], []
    for n, k in [(5, 1), (8, 1), (11, 2), (12, 2), (13, 1), (13, 2), (15, 2), (15, 3), (18, 3), (20, 4), (25, 5), (30, 6)]:
        for _ in range(8):
            item = [f"i{len(items)}x{j}" for j in range(n)]
            copy = list(item)
            for at in rng.sample(range(n), k):
                copy[at] = "other"
            rows.append((len(items), " ".join(["before"] * 50 + copy + ["after"] * 50)))
            rows.append((1000 + len(items), " ".join("other" if j % 4 == 0 else w for j, w in enumerate(item))))  # under 0.8
            items.append((len(items), " ".join(item)))
    found = decontaminate.leaks(make(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    same = lambda d: [a == b for a, b in zip(items[d % 1000][1].split(), [w for w in rows_of[d].split() if w not in ("before", "after")], strict=True)]
    rows_of = dict(rows)
    want = {(d, d % 1000) for d in rows_of if brute_stretch(same(d)) >= min(13, len(same(d)))}
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want and {(d, d) for d in range(len(items))} <= want


def test_seed_ignores_its_free_positions():
    words = np.arange(13, dtype=np.uint64)
    for mask in decontaminate.MASKS:
        for at, kept in enumerate(mask):
            other = words.copy()
            other[at] = 99
            assert (decontaminate.seeds(words, mask)[0] == decontaminate.seeds(other, mask)[0]) == (kept == "0")


def test_flag_keeps_rows_and_clashing_columns(spark):
    item = " ".join(WORDS[:20])
    docs = make(spark, [(1, item), (1, item), (2, "clean"), (None, item), (3, None)]).selectExpr("*", "1 AS items", "2 AS _doc", "3 AS overlap")
    bench = spark.createDataFrame([(5, item), (5, item)], "item_id long, text string")
    got = decontaminate.flag(docs, bench)
    assert got.columns == ["doc_id", "text", "_doc", "items", "overlap", "matches"]
    assert sorted((r.doc_id or 0, r.overlap) for r in got.collect()) == [(0, 20), (1, 20), (1, 20), (2, 0), (3, 0)]
    assert all(r["items"] is None for r in decontaminate.flag(docs, bench.where("false")).collect())
    assert decontaminate.flag(docs.where("false"), bench).count() == 0


def plan_of(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_leaves_are_never_broadcast(spark):
    nodes = common.materialize(spark.range(300).select(F.xxhash64("id").alias("fp")), "few-nodes")
    plan = plan_of(simhash.candidates(nodes))  # the files are small, but each row has 15 leaves
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    small = nodes.where("fp % 2 = 0")
    assert {tuple(r) for r in simhash.candidates(nodes).collect()} >= {tuple(r) for r in simhash.candidates(small).collect()}


def test_components_beyond_the_bound_of_broadcasts(spark, monkeypatch):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(200, 201)]
    df = spark.createDataFrame(edges, "u long, v long")
    plans = []
    kept = components.materialize
    monkeypatch.setattr(components, "materialize", lambda df, name: (plans.append(plan_of(df)), kept(df, name))[1])
    monkeypatch.setattr(components, "BROADCAST_BYTES", 0)
    got = {tuple(r) for r in components.connected_components(df).collect()}
    assert got == {(i, 0) for i in range(41)} | {(i, 100) for i in range(100, 130)} | {(200, 200), (201, 200)}
    assert not any("BroadcastHashJoin" in p for p in plans)
