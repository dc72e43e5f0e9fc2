"""Bank files, their counts, and exchange of the learning state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tallyloom.sources.shared import materialize

#: Tables of a backup; others are ignored.
BACKUP_TABLES = ("attempts", "questionStats", "tagStats", "sessions", "settings")

OPTION = T.StructType([T.StructField("key", T.StringType()), T.StructField("text", T.StringType())])
QUESTION = T.StructType(
    [
        *[T.StructField(c, T.StringType()) for c in ("id", "category", "groupId", "groupTitle")],
        T.StructField("numberInGroup", T.LongType()),
        T.StructField("stem", T.StringType()),
        T.StructField("options", T.ArrayType(OPTION)),
        *[T.StructField(c, T.StringType()) for c in ("answerKey", "answerText", "translation", "explanation")],
        *[T.StructField(c, T.ArrayType(T.StringType())) for c in ("grammarPoints", "tags")],
        T.StructField("source", T.StructType([T.StructField("file", T.StringType()), T.StructField("group", T.StringType()), T.StructField("position", T.LongType())])),
        *[T.StructField(c, T.StringType()) for c in ("status", "headword", "questionType")],
        T.StructField("multiAnswer", T.BooleanType()),
    ]
)


def read_bank(spark: SparkSession, path: str, category: str, fmt: str = "json") -> DataFrame:
    """Questions of a bank file; rows without a category get `category`."""
    reader = spark.read.schema(QUESTION)
    rows = reader.option("multiLine", True).json(path) if fmt == "json" else reader.format(fmt).load(path)
    return rows.withColumn("category", F.coalesce(F.nullif("category", F.lit("")), F.lit(category)))


def write_bank(questions: DataFrame, path: str, fmt: str = "json", by: str = "category") -> None:
    """One folder for each category, so that later scans read only what they ask for."""
    questions.write.mode("overwrite").partitionBy(by).format(fmt).save(path)


def category_counts(questions: DataFrame, categories: list[str]) -> DataFrame:
    """(category, questions): every listed category, 0 without questions."""
    listed = questions.sparkSession.createDataFrame([(c,) for c in categories], "category string")
    counts = questions.groupBy("category").agg(F.count("*").alias("n"))
    return listed.join(counts, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("questions"))


def sidecar_or_count(sidecar: DataFrame | None, questions: DataFrame, categories: list[str]) -> DataFrame:
    """The stored counts where there are any, else counted ones."""
    return category_counts(questions, categories) if sidecar is None or sidecar.isEmpty() else sidecar


def union_banks(first: DataFrame, *others: DataFrame, key: str = "id") -> DataFrame:
    """All rows; `copies` tells ids that occur in more than one bank (see `conflicts`)."""
    rows = first
    for other in others:
        rows = rows.unionByName(other, allowMissingColumns=True)
    return rows


def conflicts(rows: DataFrame, key: str = "id") -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("copies")).where("copies > 1")


def replace_prefix(rows: DataFrame, fresh: DataFrame, prefix: str, key: str = "id") -> DataFrame:
    """Rows whose id starts with `prefix` give way to `fresh`; running it twice changes nothing."""
    return rows.where(~F.startswith(F.col(key), F.lit(prefix))).unionByName(fresh, allowMissingColumns=True)


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of Markdown files, one row each."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))


def export_table(rows: DataFrame, name: str) -> DataFrame:
    """(table, row): each row as JSON; many lines rather than one document, so no task holds a whole table."""
    return rows.select(F.lit(name).alias("table"), F.to_json(F.struct(*rows.columns)).alias("row"))


def import_table(exported: DataFrame, name: str, schema: T.StructType) -> DataFrame:
    return exported.where(F.col("table") == name).select(F.from_json("row", schema).alias("r")).select("r.*")


def export_all(tables: dict[str, DataFrame], at: Column, version: int = 2) -> DataFrame:
    """(table, row): every table as JSON rows, and a row `meta` with the version, the time and the names of the tables."""
    spark = next(iter(tables.values())).sparkSession
    head = F.struct(F.lit(version).alias("version"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("exportedAt"), F.array(*[F.lit(n) for n in tables]).alias("tables"))
    out = spark.range(1).select(F.lit("meta").alias("table"), F.to_json(head).alias("row"))
    for name, rows in tables.items():
        out = out.unionByName(export_table(rows, name))
    return out


def import_all(exported: DataFrame, current: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables after an import that overwrites: those the backup names come from it, even if empty; the others stay."""
    meta = exported.where("table = 'meta'").select(F.from_json("row", "version INT, exportedAt STRING, tables ARRAY<STRING>").alias("m")).select("m.*").first()
    if meta is None or meta.version is None:
        raise ValueError("the backup has no version")
    return {name: import_table(exported, name, rows.schema) if name in (meta.tables or []) else rows for name, rows in current.items()}


def add_questions(bank: DataFrame, fresh: DataFrame, key: str = "id") -> DataFrame:
    """`bank` and the new rows; ids that would occur twice are an error."""
    both = union_banks(bank, fresh)
    repeated = [r[key] for r in conflicts(both, key).orderBy(key).limit(5).collect()]
    if repeated:
        raise ValueError(f"ids occur twice: {repeated}")
    return both


def backup_problem(payload: Column) -> Column:
    """Why a backup document cannot be imported; null if it can. Unknown keys are ignored."""
    parsed = F.try_parse_json(payload)
    kind = F.schema_of_variant(parsed)
    version = F.try_variant_get(parsed, "$.version", "double")
    typed = lambda c: F.schema_of_variant(F.try_variant_get(parsed, f"$.{c}", "variant"))
    wrong = [F.when(typed(c).isNotNull() & (typed(c) != "VOID") & ~F.startswith(typed(c), F.lit("ARRAY")), F.lit(f"table {c} is not a list")) for c in BACKUP_TABLES]
    return F.when(parsed.isNull(), "not JSON").when(~F.startswith(kind, F.lit("OBJECT")), "not an object").when(version.isNull() | ~typed("version").rlike("^(BIGINT|DOUBLE|DECIMAL)"), "no numeric version").otherwise(F.coalesce(*wrong))


def setting(value: Column, default: str) -> Column:
    """A stored setting: JSON decoded where it is JSON, as it is otherwise, the default where it is missing."""
    parsed = F.try_parse_json(value)
    return F.coalesce(F.try_variant_get(parsed, "$", "string"), value, F.lit(default))


def guarded_import(backup: Callable[[], None], load: Callable[[], None], restore: Callable[[], None]) -> None:
    """Backs up, loads, and restores the backup when loading fails."""
    backup()
    try:
        load()
    except Exception:
        restore()
        raise


def stream_events(chunks: DataFrame, path: str = "$.choices[0].delta.content") -> DataFrame:
    """(stream, line, token): the tokens of server-sent events (stream, at, chunk), numbered by line; null for lines without one.

    Chunks may cut lines. A line's number is the count of line ends before it, from sums over ranges of sorted chunks, so
    a stream of any length spreads over tasks and a row holds the pieces of one line only. Lines without `data: `, the end
    mark and bad JSON have no token. Null chunks are empty. Path of the other dialect: `$.delta.text`.
    """
    ordered = chunks.select("stream", "at", F.coalesce("chunk", F.lit("")).alias("chunk")).orderBy("stream", "at", "chunk")
    placed = materialize(ordered.select("stream", F.split("chunk", "\n").alias("pieces")).withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id()), "chunks")
    ends = F.size("pieces") - 1
    sums = placed.groupBy("stream", "_part").agg(F.sum(ends).alias("n"))
    before = sums.select("stream", "_part", (F.sum("n").over(Window.partitionBy("stream").orderBy("_part")) - F.col("n")).alias("before"))
    so_far = F.sum(ends).over(Window.partitionBy("stream", "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)) - ends
    joined = placed.withColumn("so_far", so_far).alias("c").join(before.alias("b"), F.col("c.stream").eqNullSafe(F.col("b.stream")) & (F.col("c._part") == F.col("b._part")))
    rows = joined.select("c.stream", "_at", (F.col("before") + F.col("so_far")).alias("first"), F.posexplode("pieces").alias("i", "piece"))
    lines = rows.groupBy("stream", (F.col("first") + F.col("i")).alias("line")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "piece"))), lambda x: x["piece"]), "").alias("text"))
    data = F.trim("text")
    token = F.when(F.startswith(data, F.lit("data: ")) & (data != "data: [DONE]"), F.get_json_object(F.substring(data, 7, 1 << 30), path))
    return lines.select("stream", "line", token.alias("token"))


def stream_text(chunks: DataFrame, path: str = "$.choices[0].delta.content") -> DataFrame:
    """(stream, text): the tokens of `stream_events` in order; a stream without tokens has an empty text."""
    tokens = F.array_sort(F.collect_list(F.when(F.col("token").isNotNull(), F.struct("line", "token"))))
    return stream_events(chunks, path).groupBy("stream").agg(F.array_join(F.transform(tokens, lambda x: x["token"]), "").alias("text"))
