"""Places, folds and trees in small blocks, shared folders and guards: what large inputs need, on small ones."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import markdown, ordering, quality, retrieval, state
from tallyloom.sources import banks, shared
from tests.test_state import attempts_of, brute


def test_ranked_equals_a_sort(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(20), rng.random()) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, a int, b double").repartition(7)
    got = {r.id: r["rank"] for r in ordering.ranked(df, [F.desc("a"), F.asc("b")]).collect()}
    assert got == {r[0]: k + 1 for k, r in enumerate(sorted(rows, key=lambda r: (-r[1], r[2])))}
    assert {r.id for r in ordering.ranked(df, [F.desc("a"), F.asc("b")], 9).collect()} == {i for i, k in got.items() if k <= 9}
    assert ordering.ranked(df.where("false"), [F.asc("id")]).count() == 0


def test_number_lists_restart_in_each_group(spark):
    rows = [(g, n) for g in ("a", "b", "c") for n in range(30)]
    random.Random(2).shuffle(rows)
    got = quality.number_lists(spark.createDataFrame(rows, "group_id string, n long").repartition(5), "n").collect()
    assert len(got) == 90 and all(r.place == r.number + 1 for r in got)


@pytest.mark.parametrize("block", [2, 8])
def test_fold_of_many_blocks_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(state, "BLOCK", block)
    rng = random.Random(block)
    sequences = [[(rng.random() < 0.6, rng.random() < 0.3) for _ in range(rng.choice((1, 3, 40, 200)))] for _ in range(20)]
    got = {r.question_id: (r.attempt_count, r.correct_count, r.wrong_count, r.mastery) for r in state.fold(attempts_of(spark, sequences), "question_id").collect()}
    assert got == {k: brute(s) for k, s in enumerate(sequences)}


def test_no_window_over_all_rows(spark, sf_small):
    from tallyloom import registry

    for name in ("pool_exam", "review_queue", "wrong_ids", "pool_weakness"):
        plan = registry.queries()[name](spark, sf_small)._jdf.queryExecution().executedPlan().toString()
        # the counts of the ranges are the only rows in a single task, and they are aggregated before
        assert "Window" not in plan or "_part" in plan, name


def test_tree_of_any_depth_and_circles(spark):
    rows = [(f"n{i}", f"n{i + 1}" if i < 30 else None) for i in range(31)]
    assert retrieval.ancestors(spark.createDataFrame(rows, "key string, parent string")).where("key = 'n0'").count() == 30
    with pytest.raises(ValueError, match="circle"):
        retrieval.ancestors(spark.createDataFrame([("a", "b"), ("b", "a")], "key string, parent string"))
    assert retrieval.ancestors(spark.createDataFrame([("a", None)], "key string, parent string")).count() == 0


def test_require_clean_fails_the_job(spark):
    report = spark.createDataFrame([("one", 0), ("two", 3)], "rule string, failures long")
    quality.require_clean(report.where("failures = 0"))
    with pytest.raises(ValueError, match="two: 3"):
        quality.require_clean(report)


class _Session:
    def __init__(self, **conf):
        self.conf = self
        self._values = conf

    def get(self, key, default=None):
        return self._values.get(key, default)


def test_no_machine_local_folder_on_a_cluster():
    assert shared.shared_dir(_Session(**{"spark.checkpoint.dir": "hdfs://x", "spark.master": "yarn"})) == "hdfs://x"
    assert shared.shared_dir(_Session(**{"spark.master": "local[3]"}))
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            shared.shared_dir(_Session(**{"spark.master": master}))


def test_broadcasts_are_bounded_in_bytes(spark):
    few, wide = spark.range(100), spark.range(100).select(F.repeat(F.lit("x"), 1000).alias("t"), F.array(F.lit("y" * 50)).alias("a"))
    assert shared.table_bytes(few) < 10_000 < 100_000 < shared.table_bytes(wide) < 200_000
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString().lower()
    assert hinted(shared.checked_broadcast(few)) and not hinted(shared.checked_broadcast(wide, 50_000))
    assert shared.table_bytes(few.where("false")) == 0


def test_tables_over_the_bound_are_shuffled_however_small_their_files(spark):
    # 3 MB in memory, a few KB in files: Spark by itself takes it for small enough
    wide = shared.materialize(spark.range(3000).select("id", F.lit("x" * 1000).alias("text")), "wide")
    some = spark.range(100_000)
    plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    for how in ("inner", "left", "left_anti"):
        joined = some.join(shared.checked_broadcast(wide, 1 << 20), "id", how)
        assert "BroadcastHashJoin" not in plan(joined) and "SortMergeJoin" in plan(joined)
    assert "BroadcastHashJoin" in plan(some.join(shared.checked_broadcast(wide), "id"))


def test_guarded_import_restores(spark):
    said = []

    def fail():
        raise OSError("disk")

    with pytest.raises(OSError):
        banks.guarded_import(lambda: said.append("backup"), fail, lambda: said.append("restore"))
    banks.guarded_import(lambda: said.append("backup"), lambda: said.append("load"), lambda: said.append("restore"))
    assert said == ["backup", "restore", "backup", "load"]


def test_markdown_and_bank_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("# t\n## s\n### 1. x\nA. a\nB. b\n**答案**：A\n", encoding="utf-8")
    rows = markdown.typed_questions(markdown.blocks(markdown.lines_of(banks.read_markdown(spark, str(tmp_path / "*.md"))), "^###\\s+\\d+\\."), "^###\\s+\\d+\\.\\s*(.+)$")
    assert [(r.file, r.stem, r.answer_key) for r in markdown.accepted(rows).collect()] == [("a.md", "x", "A")]
    bank = spark.createDataFrame([("q1", None, "s"), ("q2", "party", "t")], "id string, category string, stem string")
    bank.write.json(str(tmp_path / "bank"))
    read = banks.read_bank(spark, str(tmp_path / "bank"), "history", "json")
    assert {(r.id, r.category) for r in read.collect()} == {("q1", "history"), ("q2", "party")}
    banks.write_bank(read.select("id", "category", "stem"), str(tmp_path / "out"), "parquet")
    assert {r.category for r in spark.read.parquet(str(tmp_path / "out")).where("id = 'q1'").collect()} == {"history"}
    stored = spark.createDataFrame([("history", 7)], "category string, questions long")
    assert banks.sidecar_or_count(stored, read, ["history"]).first().questions == 7
    assert banks.sidecar_or_count(stored.where("false"), read, ["history"]).first().questions == 1
    assert spark.range(1).select(retrieval.ancestors_of_path(F.array(F.lit("a"), F.lit("b"), F.lit("c")))).first()[0] == ["a", "a/b"]


def test_backup_without_version_and_repeated_ids(spark):
    rows = spark.createDataFrame([(1,)], "id long")
    exported = banks.export_all({"sessions": rows}, F.lit("2024-01-01").cast("timestamp"))
    assert '"exportedAt":"2024-01-01T00:00:00.000Z"' in exported.where("table = 'meta'").first().row
    with pytest.raises(ValueError, match="version"):
        banks.import_all(exported.where("table <> 'meta'"), {"sessions": rows})
    assert banks.add_questions(rows, spark.createDataFrame([(2,)], "id long")).count() == 2
    with pytest.raises(ValueError, match="twice"):
        banks.add_questions(rows, rows)


def test_a_run_leaves_no_folders(spark):
    names = lambda: set(os.listdir(shared.shared_dir(spark)))
    before = names()
    kept = shared.materialize(spark.range(3), "kept")
    with shared.run_scope(spark):
        inner = shared.materialize(spark.range(5), "inner")
        with pytest.raises(ZeroDivisionError), shared.run_scope(spark):
            shared.materialize(spark.range(7), "failed")
            raise ZeroDivisionError
        assert inner.count() == 5 and {n.split("-")[0] for n in names() - before} == {"kept", "inner"}
    assert kept.count() == 3 and {n.split("-")[0] for n in names() - before} == {"kept"}


@pytest.mark.parametrize("split", [3, 4096])
def test_pairs_of_groups_equal_brute_force(spark, monkeypatch, split):
    monkeypatch.setattr(quality, "SPLIT", split)
    rng = random.Random(split)
    # a blank stem that all groups have, copied sets of stems, stems of a few groups, null stems and groups
    rows = [(f"g{g}", "") for g in range(20)] + [(f"g{g}", f"copy {k}") for g in range(3) for k in range(30)] + [(f"g{rng.randrange(20)}", f"stem {rng.randrange(60)}") for _ in range(200)]
    rows += [("g1", None), ("g2", None), (None, "copy 1"), ("g1", "copy 1")]
    got = [tuple(r) for r in quality.group_pairs(spark.createDataFrame(rows, "group_id string, stem string").repartition(6), 400).collect()]
    having = {}
    for group, stem in rows:
        if group is not None:
            having.setdefault((stem or "").replace(" ", ""), set()).add(group)
    shared = {}
    for groups in having.values():
        for a in groups:
            for b in groups:
                if a < b:
                    shared[a, b] = shared.get((a, b), 0) + 1
    assert got == sorted(((a, b, n) for (a, b), n in shared.items()), key=lambda x: (-x[2], x[0], x[1]))[:400]


def test_stream_of_chunks_cut_anywhere(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for stream in (None, "a", "b", "c", "hot"):
        said, lines = [], ["event: note", "", "data: [DONE]", "data: {bad", " data: {}  "]
        for k in range(2000 if stream == "hot" else 40 if stream else 3):
            token = rng.choice(["x", "two words", "line\nbreak", "", "漢字", "data: no"])
            said.append(token)
            lines.insert(rng.randrange(len(lines) + 1) if k % 7 == 0 else len(lines), json.dumps({"choices": [{"delta": {"content": token, "at": k}}]}).join(["data: ", ""]))
        body = "\n".join(lines)
        order = [json.loads(x[6:])["choices"][0]["delta"]["content"] for x in lines if x.startswith("data: {\"choices")]
        assert sorted(order) == sorted(said)
        want[stream] = "".join(order)
        at = 0
        while body:
            n = rng.randrange(1, 60)
            rows.append((stream, at, body[:n], 0))
            body, at = body[n:], at + 1
        rows.append((stream, at, None, 1))
    rows.append(("silent", 0, "event: none", 0))
    chunks = spark.createDataFrame(rows, "stream string, at long, chunk string, line int").repartition(9)
    assert {r.stream: r.text for r in banks.stream_text(chunks).collect()} == want | {"silent": ""}
    longest = banks.stream_events(chunks).groupBy("stream", "line").count().agg(F.max("count")).first()[0]
    assert longest == 1
    assert banks.stream_text(chunks.limit(0)).count() == 0
