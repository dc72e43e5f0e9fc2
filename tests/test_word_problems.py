"""Markdown banks made of parts: bounded tasks, and the problems of word banks."""

from pyspark.sql import functions as F

from tallyloom.operators import markdown
from tallyloom.plans import content, parsers
from tallyloom.sources import shared


def part_table(spark, sf_small, path, copies):
    """`copies` of the parts with shifted keys, as a folder of tables."""
    part = spark.read.parquet(f"{sf_small}/part.parquet")
    many = part.crossJoin(spark.range(copies).withColumnRenamed("id", "copy")).withColumn("p_partkey", F.col("p_partkey") + F.col("copy") * 200).drop("copy")
    many.coalesce(1).write.parquet(f"{path}/part.parquet")
    return str(path)


def test_lines_of_a_task_stay_bounded_as_parts_grow(spark, sf_small, tmp_path, monkeypatch):
    """What one task sorts and gathers does not grow with the table: more parts make more tasks, though their texts compress well."""
    monkeypatch.setattr(shared, "TASK_ROWS", 200)
    most = {}
    for copies in (10, 40):
        sf = part_table(spark, sf_small, tmp_path / str(copies), copies)
        for make in (parsers.word_lines, lambda s, d: markdown.lines_of(content.markdown_files(s, d))):
            sizes = [r["count"] for r in make(spark, sf).groupBy(F.spark_partition_id()).count().collect()]
            most.setdefault(copies, []).append((max(sizes), sum(sizes)))
    for (few, _), (many, total) in zip(most[10], most[40], strict=True):
        assert many < 1.5 * few and many < total / 12
    found = parsers.word_problems(spark, sf)
    assert found.groupBy("reason").count().count() == 4 and found.count() == 40 * 200 * 4 // 5
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_word_problems_name_each_entry_once_and_each_bad_sub_question(spark):
    option = "struct<key:string,text:string,correct:boolean,annotation:string>"
    four = [(k, k, k == "A", "") for k in "ABCD"]
    rows = [("f", 1, 1, 1, four, "A"), ("f", 1, 1, 2, four, "A"), ("f", 1, 2, 3, four, "A"), ("f", 1, 3, 4, four[:3], "A"), ("f", 1, 3, 5, four, None), ("f", 1, 3, 6, four, "A"),
            ("f", 1, 4, 7, four[:3], "A"), ("f", 1, 4, 8, four, ""), ("f", None, None, 9, four, "A"), ("f", 1, 5, 10, [*four[:3], ("D", "A", False, "")], None), ("f", 1, 5, 11, four[:0], None)]
    entries = spark.createDataFrame(rows, f"file string, lesson int, entry int, sub bigint, options array<{option}>, answer string")
    assert sorted(map(repr, (tuple(r) for r in markdown.word_problems(entries).collect()))) == sorted(map(repr, [
        ("f", 1, 2, None, "sub-questions=1"), ("f", 1, 3, None, "sub-questions=3"), ("f", 1, 4, "A", "options=3"), ("f", 1, 4, "B", "no answer"),
        ("f", None, None, None, "sub-questions=1"), ("f", 1, 5, "A", "equal options"), ("f", 1, 5, "B", "options=0"),
    ]))
