"""Registered queries: labels, categories, entry headers and prompts over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import answers, numbers, prompts, text
from tallyloom.sources.tables import table

_STORED = "CASE doc_id % 4 WHEN 0 THEN 'word' WHEN 1 THEN 'grammar' WHEN 2 THEN '' ELSE lang END"
_ID = "concat(CASE doc_id % 4 WHEN 0 THEN 'hist-' WHEN 1 THEN 'party-' WHEN 2 THEN 'mil-' ELSE 't0-' END, cast(doc_id AS string))"
_HEADER = "concat('### ', cast(doc_id AS string), '. ', source, '（', lang, '） — ', lang, ' ', source)"


def document_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    level = F.col("doc_id") % 6
    return docs.select(
        "doc_id",
        numbers.clock(F.col("n_chars")).alias("clock"),
        prompts.stars(level).alias("stars"),
        prompts.legacy_category(F.expr(_STORED)).alias("stored_category"),
        prompts.category_of_id(F.expr(_ID)).alias("id_category"),
        numbers.status_bucket(level * 20, level).alias("status"),
        numbers.goal_progress(F.col("n_chars"), F.lit(500)).alias("progress"),
        answers.question_id(F.col("source"), F.col("doc_id")).alias("question_id"),
        answers.entry_key(F.col("lang"), F.lit(None).cast("string"), F.col("doc_id")).alias("entry_key"),
    )


LABELS_SQL = """
SELECT doc_id, printf('%02d:%02d', n_chars // 60, n_chars % 60) AS clock,
  repeat('★', (doc_id % 6)::INT) || repeat('☆', (5 - doc_id % 6)::INT) AS stars,
  CASE WHEN doc_id % 4 = 3 THEN lang ELSE 'japanese2' END AS stored_category,
  CASE doc_id % 4 WHEN 0 THEN 'history' WHEN 1 THEN 'party' WHEN 2 THEN 'military' ELSE 'japanese2' END AS id_category,
  CASE WHEN doc_id % 6 >= 4 THEN 'good' WHEN doc_id % 6 = 3 THEN 'warn' WHEN doc_id % 6 > 0 THEN 'bad' ELSE 'na' END AS status,
  least(100, floor(n_chars / 500 * 100 + 0.5))::BIGINT AS progress,
  source || '-q' || lpad(doc_id::VARCHAR, 5, '0') AS question_id, lang || '||' || doc_id AS entry_key
FROM documents
"""


def entry_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = prompts.entry_header(F.expr(_HEADER))
    return table(spark, sf_dir, "documents").select("doc_id", head.alias("h")).select("doc_id", "h.*")


HEADERS_SQL = """
SELECT doc_id, doc_id AS num, source || '（' || lang || '） — ' || lang || ' ' || source AS headword, source AS kanji, lang AS kana, lang || ' ' || source AS translation FROM documents
"""


def explanation_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = F.array(F.struct(F.lit("A").alias("key"), F.col("source").alias("text")), F.struct(F.lit("B").alias("key"), F.col("lang").alias("text")))
    stem = prompts.with_article(F.col("text"), F.when(F.col("doc_id") % 2 == 0, F.col("source")))
    prompt = prompts.explanation_prompt(stem, options, F.lit("A"), F.col("source"), F.when(F.col("doc_id") % 3 == 0, F.col("lang")), F.when(F.col("doc_id") % 5 == 0, "B"), F.lit(False))
    note = prompts.note_context(F.col("source"), F.lit(""), F.when(F.col("doc_id") % 2 == 0, F.col("lang")), F.col("text"), F.lit(None).cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(prompt).alias("prompt"), F.md5(note).alias("note"))


PROMPTS_SQL = """
SELECT doc_id,
  md5('请详细解析以下题目：' || chr(10) || chr(10) || '【题干】' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN source || chr(10) || chr(10) ELSE '' END || text
    || chr(10) || chr(10) || '【选项】' || chr(10) || 'A. ' || source || chr(10) || 'B. ' || lang || chr(10) || chr(10) || '【正确答案】A. ' || source
    || CASE WHEN doc_id % 3 = 0 THEN chr(10) || chr(10) || '【原题库解析】（可能不准确，请甄别后使用）' || chr(10) || lang ELSE '' END
    || CASE WHEN doc_id % 5 = 0 THEN chr(10) || chr(10) || '【用户选择】B' || chr(10) || '用户答错了，请针对用户的理解情况进行讲解。' ELSE '' END) AS prompt,
  md5('笔记标题：' || source || CASE WHEN doc_id % 2 = 0 THEN chr(10) || '用户选中的文字：「' || lang || '」' || CASE WHEN text <> '' THEN chr(10) || '选中文字前面的内容：' || text ELSE '' END ELSE '' END) AS note
FROM documents
"""


def plain_rubies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings that equal their word go; the others stay."""
    marked = F.expr("concat('<ruby>', lang, '<rp>(</rp><rt>', CASE WHEN doc_id % 2 = 0 THEN lang ELSE source END, '</rt><rp>)</rp></ruby>', text)")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.plain_ruby(marked)).alias("digest"))


RUBIES_SQL = """
SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 OR lang = source THEN lang ELSE '<ruby>' || lang || '<rp>(</rp><rt>' || source || '</rt><rp>)</rp></ruby>' END || text) AS digest FROM documents
"""

QUERIES = {"document_labels": document_labels, "entry_headers": entry_headers, "explanation_prompts": explanation_prompts, "plain_rubies": plain_rubies}
ORACLE_SQL = {"document_labels": LABELS_SQL, "entry_headers": HEADERS_SQL, "explanation_prompts": PROMPTS_SQL, "plain_rubies": RUBIES_SQL}
