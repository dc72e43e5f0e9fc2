"""Vector operators against brute force."""

import hashlib

import numpy as np
import pytest

from tallyloom.llm import hard_negatives, hash_index, queries, vector_codes, vectors

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<float>, label int"


def make(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def some(seed, n, width=16, grid=None):
    """Rows with clusters, copies and null labels; `grid` gives many ties."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, width))
    out = []
    for i in range(n):
        v = centres[rng.integers(6)] + rng.normal(size=width) * 0.3
        v = np.round(v * grid) / grid if grid else v
        out.append((i, [float(x) for x in v.astype(np.float32)], int(rng.integers(4)) if rng.random() > 0.1 else None))
    return out


def lloyd(rows, parts, entries, rounds, scale):
    kept = sorted((r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = [[int(np.floor(float(v) * scale)) for v in r[1]] for r in kept]
    wide = len(x[0]) // parts
    cut = [[v[p * wide : (p + 1) * wide] for v in x] for p in range(parts)]
    books = [list(map(list, c[:entries])) for c in cut]
    apart = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b, strict=True))
    assign = lambda p: [min(range(len(books[p])), key=lambda k: (apart(v, books[p][k]), k)) for v in cut[p]]
    for _ in range(rounds):
        for p in range(parts):
            codes = assign(p)
            for k in range(len(books[p])):
                if own := [v for v, c in zip(cut[p], codes, strict=True) if c == k]:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    codes = [assign(p) for p in range(parts)]
    errors = [sum(apart(cut[p][i], books[p][codes[p][i]]) for p in range(parts)) for i in range(len(kept))]
    of_label = {}
    for r, e in zip(kept, errors, strict=True):
        of_label[r[2]] = of_label.get(r[2], 0) + e
    digest = hashlib.sha256(",".join(str(v) for b in books for entry in b for v in entry).encode()).hexdigest()
    return sorted((r[0] is None, r[0] or 0, "".join(f"{codes[p][i]:02x}" for p in range(parts)), errors[i], of_label[r[2]], digest) for i, r in enumerate(kept))


def coded(frame, **kind):
    return sorted((r["vec_id"] is None, r["vec_id"] or 0, r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in vector_codes.compress(frame, **kind).collect())


@pytest.mark.parametrize(("seed", "grid", "entries"), [(1, None, 16), (2, 2, 16), (3, 1, 5)])
def test_codes_equal_plain_rounds(spark, seed, grid, entries):
    rows = some(seed, 300, grid=grid)
    rows += [(300 + i, rows[7][1], 3) for i in range(100)]  # a large group of copies
    rows += [(500, None, 1), (501, [NAN] * 16, 1), (502, [INF] + [0.0] * 15, None), (503, [None] + [0.0] * 15, 2), (None, [0.5] * 16, 2), (7, rows[7][1], 1), (7, rows[8][1], 1), (504, [0.0] * 16, 2)]
    kind = {"parts": 4, "entries": entries, "rounds": 4, "scale": 64}
    assert coded(make(spark, rows).repartition(5), **kind) == lloyd(rows, **kind)


def test_codes_of_few_none_and_odd_vectors(spark):
    few = [(5, [1.0, -1.0], 1), (9, [0.25, 2.0], None)]
    kind = {"parts": 2, "entries": 16, "rounds": 3, "scale": 4096}
    assert coded(make(spark, few), **kind) == lloyd(few, **kind)
    assert coded(make(spark, [(1, [NAN, 0.0], 1), (2, None, None)]), **kind) == []
    clash = make(spark, [(*r, "x", 3) for r in few], f"{SCHEMA}, codes string, error int")
    assert coded(clash, **kind) == lloyd(few, **kind)
    for odd in ([(1, [1.0, 2.0], 1), (2, [1.0], 1)], [(1, [1.0, 2.0, 3.0], 1)], [(1, [1e30, 2.0], 1)]):
        with pytest.raises(ValueError):
            vector_codes.compress(make(spark, odd), **kind)


def test_search_leaves_out_far_entries():
    rng = np.random.default_rng(4)
    book = rng.integers(-4000, 4000, (64, 2))
    rows = book[rng.integers(64, size=2000)] + rng.integers(-50, 50, (2000, 2))
    apart = ((rows[:, None] - book[None]) ** 2).sum(2)
    start = apart.argmin(1)
    entry, best, computed = vector_codes.nearest(rows, book, start, vector_codes.around(book))
    assert (entry == apart.argmin(1)).all() and (best == apart.min(1)).all()
    assert computed < 3 * len(rows)  # of 64 entries
    wrong = rng.integers(64, size=2000)
    assert (vector_codes.nearest(rows, book, wrong, vector_codes.around(book))[0] == apart.argmin(1)).all()


def test_moved_rounds_down_and_leaves_unused_entries():
    books = np.array([[[5], [7]]])
    assert vector_codes.moved(books, np.array([[[-7, 2], [0, 0]]])).tolist() == [[[-4], [7]]]


def test_tiles_meet_once(spark):
    index, queries = spark.range(5000).withColumnRenamed("id", "vec_id"), spark.range(40).withColumnRenamed("id", "query_id")
    a, b = vectors.tiles(index, queries, 5000, 9000)  # five shards, three tiles
    pairs = a.join(b, ["shard", "tile"])
    assert pairs.count() == pairs.select("vec_id", "query_id").distinct().count() == 5000 * 40
    assert vectors.shard_count(0) == 1 and vectors.shard_count(10**9) == -(-(10**9) // vectors.SHARD_ROWS)


def exact_nearest(rows, k, every=100):
    """Of each query the k nearest rows of another id, by brute force; ids are unique here."""
    kept = [(i, np.array(v, float)) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ids, x = np.array([i for i, _ in kept]), np.array([v for _, v in kept])
    out = {}
    for i, v in kept:
        if i % every == 0:
            far = np.sqrt(((x - v) ** 2).sum(1))
            out[i] = [(int(ids[j]), float(far[j])) for j in np.lexsort((ids, far)) if ids[j] != i][:k]
    return out


def found(frame, k=10, every=100):
    got = {}
    for r in hash_index.search(hash_index.build(frame, k), frame.where(f"vec_id % {every} = 0"), k).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert all([x[0] for x in sorted(v)] == list(range(1, len(v) + 1)) for v in got.values())
    return {q: [x[1:] for x in sorted(v)] for q, v in got.items()}


def recall(got, want):
    return sum(len({i for i, _ in w} & {i for i, _ in got.get(q, [])}) for q, w in want.items()) / max(1, sum(map(len, want.values())))


def test_index_recall_on_tables(spark, sf_oracle):
    """The registered query, on vectors that lie evenly around the origin."""
    rows = spark.read.parquet(f"{sf_oracle}/embeddings.parquet").collect()
    got = {}
    for r in queries.op12_hash_index(spark, sf_oracle).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = exact_nearest([(r["vec_id"], r["embedding"]) for r in rows], 10)
    assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
    got = {q: [x[1:] for x in sorted(v)] for q, v in got.items()}
    assert recall(got, want) >= 0.95
    assert all(s == pytest.approx(dict(want[q]).get(i, s), abs=1e-12) for q, v in got.items() for i, s in v)


def test_index_on_clusters_and_copies(spark):
    rows = some(11, 4000, width=24)
    rows += [(4000 + i, rows[100][1], 1) for i in range(1300)]  # a third are copies of a query
    rows += [(9000 + i, [x + 0.001 * i for x in rows[200][1]], 1) for i in range(50)]
    got, want = found(make(spark, rows).repartition(6)), exact_nearest(rows, 10)
    assert got.keys() == want.keys() and recall(got, want) >= 0.95
    assert [i for i, _ in got[100]] == list(range(4000, 4010))  # ties to the smaller id


def test_index_ranks_few_codes_where_neighbours_are_near(spark):
    """Groups of 12 copies with noise: those of a query are found over all shards, and few other codes are ranked."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(np.tile(rng.normal(size=(400, 64)), (12, 1)) + rng.normal(size=(4800, 64)) * 0.02)]
    frame = make(spark, rows)
    index = hash_index.build(frame, 10)
    got = hash_index.search(index, frame.where("vec_id % 100 = 0"), 10).collect()
    assert {(r["query_id"], r["vec_id"]) for r in got} == {(q, i) for q, v in exact_nearest(rows, 10).items() for i, _ in v}
    assert np.median([r["probed"] for r in got]) < 0.05 * 4800 / vectors.shard_count(4800)


def test_index_edges(spark):
    few = [(0, [1.0, 0.0], 1), (100, [0.0, 1.0], None), (3, [1.0, 0.0], 1), (4, [0.0, 0.0], 1), (5, None, 1), (6, [NAN, 1.0], 1), (7, [None, 1.0], 1), (8, [INF, 1.0], 1), (None, [1.0, 0.0], 1), (9, [], 1)]
    assert found(make(spark, few)) == {0: [(3, 0.0), (100, pytest.approx(2**0.5))], 100: [(0, pytest.approx(2**0.5)), (3, pytest.approx(2**0.5))]}
    repeated = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (0, [0.5, 0.0], 1), (1, [1.0, 1.0], 1), (1, [1.0, 1.0], 1)]
    assert found(make(spark, repeated)) == {0: [(1, pytest.approx(1.25**0.5))] * 2}
    assert found(make(spark, [])) == {} == found(make(spark, [(1, [1.0, 2.0], 1)]))
    assert len(found(make(spark, [(*r, 1, 2) for r in few], f"{SCHEMA}, code int, query_id int"))) == 2
    same = [(i, [1.0] * 5, 1) for i in range(300)]
    assert all([i for i, _ in v] == [i for i in range(12) if i != q][:10] for q, v in found(make(spark, same)).items())
    with pytest.raises(ValueError):
        found(make(spark, [(1, [1.0], 1), (2, [1.0, 2.0], 1)]))


@pytest.mark.parametrize("radius", [0, 3, 11, 24, 64])
def test_probing_loses_no_code(radius):
    rng = np.random.default_rng(radius)
    codes = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    codes[:500] = codes[0] ^ np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64)
    for cuts in ([(0, 16), (16, 16), (32, 16), (48, 16)], [(0, 8), (8, 8)], [(0, 32), (32, 32)]):
        shard = hash_index.Shard(np.arange(3000), np.zeros((3000, 1)), codes & np.uint64((1 << sum(w for _, w in cuts)) - 1), cuts)
        for code in (shard.codes[0], shard.codes[700]):
            assert shard.probe(code, radius).tolist() == np.flatnonzero(np.bitwise_count(shard.codes ^ code) <= radius).tolist()


def mined_plainly(rows, every, positives=5, negatives=10, scale=256):
    kept = [(i, [int(np.floor(float(x) * scale)) for x in v], lab) for i, v, lab, *_ in rows if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    least = {}
    for i, v, lab in kept:
        if i % every == 0:
            least[i] = min(least.get(i, (v, lab)), (v, lab))
    out = []
    for i, (a, own) in least.items():
        scored = sorted((-sum(x * y for x, y in zip(a, v, strict=True)), j, lab) for j, v, lab in kept)
        for score, pos, _ in [s for s in scored if s[2] == own and s[1] != i][:positives]:
            window = [(s, j) for s, j, lab in scored if lab != own and 30 * -score <= 100 * -s <= 90 * -score]
            out += [(i, pos, rank, j, -score, -s) for rank, (s, j) in enumerate(window[:negatives], 1)]
    return sorted(out)


def mined(frame, every):
    return sorted(tuple(r)[:6] for r in hard_negatives.mine(frame, f"vec_id % {every} = 0").collect())


@pytest.mark.parametrize(("seed", "grid"), [(21, None), (22, 4)])
def test_mining_equals_brute_force(spark, seed, grid):
    rows = [(i, v, lab) for i, v, lab in some(seed, 2500, width=15, grid=grid)]  # an odd width; ties on the grid
    rows += [(2500 + i, rows[50][1], 2) for i in range(1200)]  # a third are copies of an anchor, of one label
    rows += [(50, rows[51][1], 1), (50, rows[51][1], 1), (5001, None, 1), (5002, [NAN] * 15, 1), (5003, [None] * 15, 1), (None, [1.0] * 15, 1), (5050, [0.0] * 15, 3), (5100, [-x for x in rows[3][1]], 0)]
    assert mined(make(spark, rows).repartition(5), 50) == mined_plainly(rows, 50)


def test_mining_of_few_rows(spark):
    few = [(0, [1.0, 0.5], 1), (1, [1.0, 0.25], 1), (2, [0.5, 0.25], 2), (3, [0.5, 0.25], 2), (4, [9.0, 9.0], 3), (100, [1.0, 1.0], 7)]
    assert mined(make(spark, few), 100) == mined_plainly(few, 100) != []
    assert mined(make(spark, [(*r, 1, "x") for r in few], f"{SCHEMA}, ints int, codes string"), 100) == mined_plainly(few, 100)
    assert mined(make(spark, []), 100) == mined(make(spark, [(0, [1.0], None)]), 100) == []
    for odd in ([(1, [1.0, 2.0], 1), (2, [1.0], 1)], [(1, [1e30, 2.0], 1)]):
        with pytest.raises(ValueError):
            mined(make(spark, odd), 100)


def test_residual_bounds_hold_and_filter():
    rng = np.random.default_rng(31)
    rows = rng.normal(size=(6000, 64))
    rows = np.floor(256 * rows / np.linalg.norm(rows, axis=1, keepdims=True)).astype(np.int64)
    books = hard_negatives.fit(rows[:2000])
    shard = hard_negatives.Shard(books, np.arange(6000), np.zeros(6000, int), rows, *hard_negatives.encode(rows, books))
    every = np.arange(6000)
    low, high = shard.bounds(rows[7], every)
    score = rows @ rows[7]
    assert (low <= score).all() and (score <= high).all()
    (_, places, scores, tried), = shard.best(rows[7], every, [(0, 5000, 15000)], 10)
    inside = [i for i in np.lexsort((every, -score)) if 5000 <= score[i] <= 15000][:10]
    assert places.tolist() == inside and scores.tolist() == score[inside].tolist()
    assert tried < 0.3 * ((score >= 5000) & (score <= 15000)).sum() + 0.3 * 6000
