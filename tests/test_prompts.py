from pyspark.sql import functions as F

from tallyloom.functions import prompts


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def test_shares_reading(spark):
    share = lambda a, b: value(spark, prompts.shares_reading(F.lit(a), F.lit(b)))
    assert share("漢字", "漢方") and not share("漢字", "方") and not share("かな", "かな") and not share("漢字", "漢、无")


def test_missing_parts(spark):
    none = F.lit(None).cast("string")
    assert value(spark, prompts.category_of_id(none)) == "japanese2"
    assert value(spark, prompts.legacy_category(none)) == "japanese2"
    assert value(spark, prompts.entry_header(F.lit("## no entry"))) is None
    assert value(spark, prompts.note_context(none, none, none, none, none)) == ""
    assert value(spark, prompts.with_article(F.lit("s"), F.lit(""))) == "s"


def test_header_without_reading(spark):
    assert tuple(value(spark, prompts.entry_header(F.lit("### 3. 漢字 — word — x")))) == (3, "漢字 — word — x", "漢字 — word — x", "", "word — x")
