"""Registered queries: Markdown banks of every format, their reports, domain dedup, tags and altered options."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.functions import alternatives, answers, prompts, text
from tallyloom.operators import history, markdown, quality
from tallyloom.plans.content import BLANK_SQL, FILE_SQL, KEYED_SQL, NORM_PARSER_SQL, NORM_SQL, markdown_files, options_of, parts_by_file
from tallyloom.sources.tables import QUESTIONS_SQL, questions, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return register


def files_of(spark, sf, section: str, block: str):
    """Files made of the parts of `FILE`: `section` is a header by part, `block` the text below; parts of a section stay together."""
    part = parts_by_file(spark, sf).select("file", F.expr(section).alias("section"), "p_partkey", F.expr(block).alias("block"))
    texts = part.groupBy("file", "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "block"))), lambda r: r["block"]), "\n").alias("text"))
    pieces = F.array_sort(F.collect_list(F.struct("section", "text")))
    return texts.groupBy("file").agg(F.concat(F.lit("# title\nbefore any section\n"), F.array_join(F.transform(pieces, lambda s: F.concat(s["section"], F.lit("\n\n"), s["text"])), "\n")).alias("text"))


PARTY_SECTION = "element_at(array('## 第一优先级 必考', '## 第二优先级', '## 填空题', '## 第三优先级', '## 第四优先级'), cast(p_partkey % 5 + 1 AS int))"
PARTY_ANSWER = "element_at(array('**答案**：A', '**答案**: CA', '**答案**：正确', concat('**答案**：', p_type), 'no answer', '**答案**：J', '**答案**：说不清'), cast(p_partkey % 7 + 1 AS int))"
PARTY_BLOCK = f"concat('**', p_partkey, '. ', p_name, '**\n\nand  more\nA.', p_brand, ' B.', p_type, ' C、x\nlate line\nD. y\nD. z\n', {PARTY_ANSWER}, '\n\n**解析**：because ', p_size, '\n\n\n\n**标签**：a·b\n\n---\nafter the rule')"


@query(
    "party_questions",
    f"""WITH p AS (SELECT *, {FILE_SQL} AS file, p_partkey % 5 AS s, p_partkey % 7 AS a FROM part WHERE p_partkey % 5 <> 2 AND p_partkey % 7 < 4)
SELECT file, 'p' || CASE WHEN s < 2 THEN s + 1 ELSE s END AS "group", row_number() OVER (PARTITION BY file, s ORDER BY p_partkey) AS number, p_name || ' and more' AS stem, CASE a WHEN 2 THEN 2 ELSE 4 END AS n_options,
  CASE a WHEN 1 THEN 'multi' WHEN 2 THEN 'judgement' ELSE 'single' END AS kind, ['A', 'AC', 'A', 'B'][a + 1] AS answer_key, CASE a WHEN 0 THEN p_brand WHEN 1 THEN p_brand || ' / x' WHEN 2 THEN '正确' ELSE p_type END AS answer_text,
  'because ' || p_size || chr(10) || chr(10) || '**标签**：a·b' AS explanation FROM p""",
)
def party_questions(spark, sf):
    lines = markdown.lines_of(files_of(spark, sf, PARTY_SECTION, PARTY_BLOCK))
    found = markdown.bold_questions(markdown.tracked_blocks(lines, markdown.PRIORITY_SECTIONS + markdown.KIND_SECTIONS), "party")
    return found.select("file", "group", "number", "stem", F.size("options").alias("n_options"), "kind", "answer_key", "answer_text", "explanation")


MILITARY_SECTION = "element_at(array('## 一、总论', '## 十八、其他（补充）', '## 附录', '## 第一优先级'), cast(p_partkey % 4 + 1 AS int))"
MILITARY_BODY = """CASE p_partkey % 6
  WHEN 0 THEN concat('A. ', p_brand, '\nB. ', p_type, '\n**答案**：A') WHEN 1 THEN 'A. 正确\nB. 错误\n**答案**：错误（实质错误）' WHEN 2 THEN '**答案**：很多年'
  WHEN 3 THEN concat('A. ', p_brand, '\nB. ', p_type, '\nC. x\n**答案**：', p_type, '和', p_brand) WHEN 4 THEN 'A. real\nB. 国家\nC. 军队\nD. 政府\nE. 人民\n**答案**：A' ELSE '**答案**：对' END"""
MILITARY_BLOCK = f"concat('**', p_partkey, '、', p_name, '**\n', {MILITARY_BODY}, '\n\n**bold note**\nplain ', p_size, '\n**答案**：again\nnot read')"


@query(
    "military_questions",
    f"""WITH p AS (SELECT *, {FILE_SQL} AS file, p_partkey % 4 AS s, p_partkey % 6 AS a FROM part WHERE p_partkey % 4 <> 2 AND p_partkey % 6 <> 4)
SELECT file, ['ch1', 'ch18', '', 'p1'][s + 1] AS "group", row_number() OVER (PARTITION BY file, s ORDER BY p_partkey) AS number, p_name AS stem, [2, 2, 0, 3, 5, 2][a + 1] AS n_options,
  ['single', 'judgement', 'fill', 'multi', '', 'judgement'][a + 1] AS kind, ['A', 'B', '很多年', 'AB', '', 'A'][a + 1] AS answer_key,
  CASE a WHEN 0 THEN p_brand WHEN 1 THEN '错误' WHEN 2 THEN '很多年' WHEN 3 THEN p_brand || ' / ' || p_type ELSE '正确' END AS answer_text, 'bold note' || chr(10) || 'plain ' || p_size AS explanation FROM p""",
)
def military_questions(spark, sf):
    lines = markdown.lines_of(files_of(spark, sf, MILITARY_SECTION, MILITARY_BLOCK))
    found = markdown.bold_questions(markdown.tracked_blocks(lines, markdown.PRIORITY_SECTIONS + markdown.PART_SECTIONS, chapters=True), "military")
    return found.select("file", "group", "number", "stem", F.size("options").alias("n_options"), "kind", "answer_key", "answer_text", "explanation")


HISTORY_SECTION = "element_at(array('## 第一套', '## 第一套 again\n\n### 填空题', '## 第三章 x', '## 第二套 y', '### 填空题（模拟）'), cast(p_partkey % 5 + 1 AS int))"
HISTORY_BODY = """CASE p_partkey % 7
  WHEN 0 THEN concat('and  more\nA. ', p_brand, ' B. ', p_type, ' C、x\nlate line\n**答案：A**') WHEN 1 THEN concat('A. ', p_brand, '\nB. ', p_type, '\nC) x\nC. y\n**答案: CA **') WHEN 2 THEN 'A. 正确\nB. 错误\n**答案：A**'
  WHEN 3 THEN '**答案：错**' WHEN 4 THEN 'A. no answer\nB. y' WHEN 5 THEN 'A. x\nB. y\n**答案：AD**' ELSE 'A. x\nB. y\n\n**答案：D**' END"""
HISTORY_TOLD = "CASE WHEN p_partkey % 2 = 0 THEN concat('bold\n**解析：** because ', p_size, '\n\n\n\nmore', CASE WHEN p_partkey % 7 = 4 THEN '' ELSE '\n**答案：B**\nnot read' END) ELSE concat('**bold note**\n\nplain ', p_size) END"
HISTORY_BLOCK = f"""concat(replace(concat(CASE WHEN p_partkey % 3 = 1 THEN '> #### ' ELSE '### ' END, p_partkey, CASE WHEN p_partkey % 3 = 2 THEN '、' ELSE '. ' END, '[来源：a.md] ', p_name, '（B）\n', {HISTORY_BODY}, '\n\n', {HISTORY_TOLD}),
  '\n', CASE WHEN p_partkey % 3 = 1 THEN '\n> ' ELSE '\n' END), '\n---\nafter the rule')"""


@query(
    "history_questions",
    f"""WITH p AS (SELECT *, {FILE_SQL} AS file, p_partkey % 5 AS s, p_partkey % 7 AS a, p_partkey // 500 % 2 = 0 AS subsets FROM part), t AS (
  SELECT *, CASE WHEN NOT subsets THEN 0 WHEN s >= 3 AND bool_or(s = 3) OVER w THEN 3 WHEN s >= 1 AND bool_or(s = 1) OVER w THEN 2 WHEN bool_or(s = 0) OVER w THEN 1 ELSE 0 END AS set_no,
    s = 1 OR (s >= 3 AND bool_or(s = 1) OVER w AND NOT bool_or(s = 2) OVER w AND (NOT subsets OR (s = 4 AND NOT bool_or(s = 3) OVER w))) AS fill FROM p WINDOW w AS (PARTITION BY file)
), k AS (SELECT * FROM t WHERE a <> 4 AND (a <> 5 OR fill))
SELECT file, file || ['', '-1', '-1', '-2'][set_no + 1] AS "group", 'bank ' || file || ['', ' 第一套', ' 第一套', ' 第二套'][set_no + 1] AS title,
  row_number() OVER (PARTITION BY file, set_no ORDER BY s, p_partkey) AS number,
  p_name || CASE WHEN NOT fill THEN CASE a WHEN 0 THEN ' and more' ELSE '' END ELSE CASE a WHEN 0 THEN ' and more A. ' || p_brand || ' B. ' || p_type || ' C、x late line' WHEN 1 THEN ' A. ' || p_brand || ' B. ' || p_type || ' C) x C. y'
    WHEN 2 THEN ' A. 正确 B. 错误' WHEN 3 THEN '' ELSE ' A. x B. y' END END AS stem,
  CASE WHEN fill THEN 0 ELSE [3, 3, 2, 2, 0, 0, 2][a + 1] END AS n_options, CASE WHEN fill THEN 'fill' ELSE ['single', 'multi', 'judgement', 'judgement', '', '', 'single'][a + 1] END AS kind,
  CASE WHEN fill THEN 'FILL' ELSE ['A', 'AC', 'A', 'B', '', '', 'D'][a + 1] END AS answer_key,
  CASE WHEN fill THEN ['A', 'CA', 'A', '错', '', 'AD', 'D'][a + 1] ELSE CASE a WHEN 0 THEN p_brand WHEN 1 THEN p_brand || ' / x' WHEN 2 THEN '正确' WHEN 3 THEN '错误' ELSE '' END END AS answer_text,
  CASE WHEN p_partkey % 2 = 0 THEN 'because ' || p_size || chr(10) || chr(10) || 'more' ELSE 'bold note' || chr(10) || 'plain ' || p_size END AS explanation FROM k""",
)
def history_questions(spark, sf):
    """Files with an even number have sub-sets; in the others these headings are lines like any other."""
    files = files_of(spark, sf, HISTORY_SECTION, HISTORY_BLOCK)
    specs = files.select("file", F.col("file").alias("group"), F.concat(F.lit("bank "), "file").alias("title"), (F.substring_index("file", "/", -1).cast("int") % 2 == 0).alias("subsets"))
    found = history.history_questions(history.marked_blocks(markdown.lines_of(files), specs))
    return found.select("file", "group", "title", "number", "stem", F.size("options").alias("n_options"), "kind", "answer_key", "answer_text", "explanation")


@query(
    "scoped_blocks",
    f"""WITH p AS (SELECT *, {FILE_SQL} AS file FROM part WHERE p_partkey % 5 = 1) SELECT file, count(*) AS blocks, count(*) * 10 AS body_lines FROM p GROUP BY file""",
)
def scoped_blocks(spark, sf):
    """Blocks of the second priority: a body runs from its header to the rule below its ten lines."""
    lines = markdown.lines_of(files_of(spark, sf, PARTY_SECTION, PARTY_BLOCK.replace("\n---\nafter the rule", "\n---")))
    boundary = "^\\*\\*\\s*\\d+\\s*[.、]|^---\\s*$|^##\\s"
    found = markdown.scoped_blocks(lines, markdown.BOLD_HEADER, boundary, "^##\\s+第二优先级", "^##\\s+(?!第二优先级)")
    return found.groupBy("file").agg(F.count("*").alias("blocks"), F.sum(F.least(F.col("body_end") - F.col("body_start"), F.lit(10))).alias("body_lines"))


WORD_BLOCK = """concat('### ', p_partkey, '. 漢', p_size, '字（かな', p_size, '） — ', p_name, '\n\n**A. 给假名选汉字：かな**\n- A. a', p_size, ' ✅【note】\n- B. b【n】\n- C. c', CASE WHEN p_partkey % 5 = 4 THEN '' ELSE '\n- D. d' END,
  CASE WHEN p_partkey % 5 = 1 THEN '' ELSE concat('\n**B. 给汉字选假名：漢字**\n- A. e\n- B. ', CASE WHEN p_partkey % 5 = 2 THEN 'e' ELSE 'f' END, '\n- C. g', p_size % 7, CASE WHEN p_partkey % 5 = 3 THEN '' ELSE ' ✅' END, '\n- D. h') END)"""
WORD_SECTION = "concat('## 第', 26 + p_partkey % 3, '课')"


def word_lines(spark, sf):
    return markdown.lines_of(files_of(spark, sf, WORD_SECTION, WORD_BLOCK))


@query(
    "word_entries",
    f"""WITH p AS (SELECT *, {FILE_SQL} AS file, (26 + p_partkey % 3)::INTEGER AS lesson FROM part), s AS (SELECT *, 'A' AS label FROM p UNION ALL SELECT *, 'B' FROM p WHERE p_partkey % 5 <> 1)
SELECT file, lesson, p_partkey::INTEGER AS entry, '漢' || p_size || '字' AS kanji, 'かな' || p_size AS kana, p_name AS translation, label, CASE WHEN label = 'A' AND p_partkey % 5 = 4 THEN 3 ELSE 4 END AS n_options,
  CASE WHEN label = 'A' THEN 'A' WHEN p_partkey % 5 <> 3 THEN 'C' END AS answer FROM s""",
)
def word_entries(spark, sf):
    nth = F.row_number().over(Window.partitionBy("file", "lesson", "entry").orderBy("sub"))
    found = markdown.word_entries(word_lines(spark, sf))
    return found.select("file", "lesson", "entry", "kanji", "kana", "translation", F.when(nth == 1, "A").otherwise("B").alias("label"), F.size("options").alias("n_options"), "answer")


@query(
    "word_problems",
    f"""WITH p AS (SELECT *, {FILE_SQL} AS file, (26 + p_partkey % 3)::INTEGER AS lesson, p_partkey % 5 AS v FROM part)
SELECT file, lesson, p_partkey::INTEGER AS entry, CASE v WHEN 2 THEN 'B' WHEN 3 THEN 'B' WHEN 4 THEN 'A' END AS sub, ['', 'sub-questions=1', 'equal options', 'no answer', 'options=3'][v + 1] AS reason FROM p WHERE v > 0""",
)
def word_problems(spark, sf):
    return markdown.word_problems(markdown.word_entries(word_lines(spark, sf)))


@query("bare_options", "SELECT 'kana-to-kanji' AS mode, 'c' AS text UNION SELECT 'kana-to-kanji', 'd' FROM part WHERE p_partkey % 5 <> 4 UNION SELECT 'kanji-to-kana', unnest(['e', CASE WHEN p_partkey % 5 = 2 THEN 'e' ELSE 'f' END, 'g' || (p_size % 7), 'h']) FROM part WHERE p_partkey % 5 <> 1")
def bare_options(spark, sf):
    return markdown.bare_options(word_lines(spark, sf))


@query("report_headings", f"SELECT {FILE_SQL} AS file, (26 + p_partkey % 3)::INTEGER AS lesson, p_partkey AS num, '漢' || p_size || '字' AS head, '漢字' AS kanji FROM part WHERE p_partkey % 5 = 1")
def report_headings(spark, sf):
    """The headings of the entries that were skipped for a missing sub-question."""
    lines = word_lines(spark, sf)
    skipped = markdown.word_problems(markdown.word_entries(lines)).where("sub IS NULL").select("file", "lesson", F.col("entry").cast("bigint").alias("num"))
    return markdown.headings_of(skipped, lines)


@query(
    "parser_report",
    "SELECT unnest(['no_stem', 'few_options', 'no_answer', 'no_explanation', 'answer_not_in_options', 'rejected']) AS rule, unnest([0, 0, n, 0, n, n]) AS failures FROM (SELECT count(*) FILTER (p_partkey % 3 = 2) AS n FROM part)",
)
def parser_report(spark, sf):
    found = markdown.typed_questions(markdown.blocks(markdown.lines_of(markdown_files(spark, sf)), "^###\\s+\\d+\\."), "^###\\s+\\d+\\.\\s*(.+)$")
    return quality.audit(found, {**quality.parser_rules(), "rejected": F.col("kind") == "skip"})


@query("rewritten_files", f"SELECT {FILE_SQL} AS file, count(*) FILTER (p_partkey % 3 <> 2) AS blocks, count(*) FILTER (p_partkey % 3 <> 2) AS last_number FROM part GROUP BY 1 HAVING count(*) FILTER (p_partkey % 3 <> 2) > 0")
def rewritten_files(spark, sf):
    """Files without their unusable blocks, numbered anew, read back."""
    found = markdown.blocks(markdown.lines_of(markdown_files(spark, sf)), "^###\\s+\\d+\\.")
    bad = markdown.rejected(markdown.typed_questions(found, "^###\\s+\\d+\\.\\s*(.+)$")).select("file", "section", "block")
    again = markdown.lines_of(markdown.rewritten(found.join(bad, ["file", "section", "block"], "left_anti")))
    number = F.regexp_extract("line", "^###\\s+(\\d+)\\.", 1)
    return again.where(number != "").groupBy("file").agg(F.count("*").alias("blocks"), F.max(number.cast("bigint")).alias("last_number"))


def with_options(spark, sf):
    n = F.col("id") % 4 + 1
    options = F.transform(F.sequence(F.lit(1).cast("bigint"), n), lambda i: F.struct(F.char(i + 64).alias("key"), i.cast("string").alias("text")))
    return questions(spark, sf).select("id", "position", "group_id", "stem", F.expr("CASE id % 3 WHEN 0 THEN 'multi' WHEN 1 THEN 'fill' ELSE 'single' END").alias("question_type"), options.alias("options"), F.col("category").alias("explanation"))


DOMAINS = [["src2", "src1", "src3"], ["src4"], ["src5", "src6", "src7"]]


@query(
    "domain_dedup",
    f"""WITH {QUESTIONS_SQL}, d(group_id, domain, place) AS (VALUES ('src2', 0, 0), ('src1', 0, 1), ('src3', 0, 2), ('src4', 1, 0), ('src5', 2, 0), ('src6', 2, 1), ('src7', 2, 2)),
k AS (SELECT *, md5({NORM_PARSER_SQL.replace("text", "stem")} || '|' || CASE id % 3 WHEN 0 THEN 'multi' WHEN 1 THEN 'fill' ELSE 'single' END) AS key FROM questions JOIN d USING (group_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY domain, key ORDER BY id IN (4, 16, 64), id % 4 DESC, place, length(category) DESC, position) AS n FROM k)
SELECT id, group_id FROM r WHERE n = 1 AND NOT (id % 3 = 0 AND id % 4 < 2)""",
)
def domain_dedup(spark, sf):
    return quality.domain_dedup(with_options(spark, sf), DOMAINS, [4, 16, 64]).select("id", "group_id")


@query(
    "global_dedup",
    f"""WITH {QUESTIONS_SQL}, k AS (SELECT *, md5({NORM_PARSER_SQL.replace("text", "stem")} || '|' || CASE id % 3 WHEN 0 THEN 'multi' WHEN 1 THEN 'fill' ELSE 'single' END) AS key FROM questions WHERE id NOT IN (4, 16, 64)),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY id % 4 DESC, CASE WHEN regexp_matches(group_id, '^src[1-3]$') THEN 0 WHEN starts_with(group_id, 'src1') THEN 1 ELSE 2 END, length(category) DESC, position) AS n FROM k)
SELECT id, group_id FROM r WHERE n = 1""",
)
def global_dedup(spark, sf):
    """One domain, priorities by the group's name, and rows that were dropped by hand."""
    dropped = spark.createDataFrame([(4,), (16,), (64,)], "gone long")
    rows = with_options(spark, sf).join(dropped, F.col("id") == F.col("gone"), "left_anti")
    prior = F.when(F.col("group_id").rlike("^src[1-3]$"), 0).when(F.startswith("group_id", F.lit("src1")), 1).otherwise(2)
    key = F.concat_ws("|", text.norm_parser(F.col("stem")), F.col("question_type"))
    return quality.ranked_dedup(rows, [F.desc(F.size("options")), prior.asc(), F.desc(F.length("explanation"))], key=key).select("id", "group_id")


@query(
    "resolved_conflicts",
    f"""WITH {QUESTIONS_SQL}, {KEYED_SQL}, v AS (SELECT key, group_id AS answer, count(*) AS votes, min(position) AS first, arg_min(id, position) AS id FROM keyed GROUP BY ALL),
w AS (SELECT key, id AS winner, count(*) OVER (PARTITION BY key) AS answers FROM v QUALIFY row_number() OVER (PARTITION BY key ORDER BY votes DESC, first) = 1),
o AS (SELECT key, string_agg(answer, ' / ' ORDER BY first) AS others FROM (SELECT key, group_id AS answer, min(position) AS first FROM keyed JOIN w USING (key) WHERE answers > 1 AND id <> winner GROUP BY ALL) GROUP BY key)
SELECT k.id, CASE WHEN answers > 1 THEN '【存疑·原题库存在答案分歧：' || others || '】 ' END AS note FROM keyed k JOIN w USING (key) LEFT JOIN o USING (key) WHERE answers = 1 OR k.id = winner""",
)
def resolved_conflicts(spark, sf):
    return quality.resolve_conflicts(questions(spark, sf), F.col("group_id")).select("id", "note")


@query("sub_headers_removed", "SELECT doc_id AS id FROM documents WHERE doc_id % 5 NOT IN (0, 2)")
def sub_headers_removed(spark, sf):
    stem = F.expr("CASE id % 5 WHEN 0 THEN concat('一、单选题', stem) WHEN 1 THEN concat('七、单选题', stem) WHEN 2 THEN '三、判断正误题（共十题）' ELSE stem END")
    return quality.without_sub_headers(questions(spark, sf).withColumn("stem", stem)).select("id")


GROUP_FILES = {"low": ["src1", "src2"], "mid": ["src3"], "rest": ["src4", "src5", "src6"]}


@query(
    "file_report",
    f"""WITH {QUESTIONS_SQL}, {KEYED_SQL}, f(group_id, file) AS (VALUES ('src1', 'low'), ('src2', 'low'), ('src3', 'mid'), ('src4', 'rest'), ('src5', 'rest'), ('src6', 'rest')),
k AS (SELECT file, key, count(*) AS n, count(DISTINCT group_id) AS g, key <> md5('') AS real FROM keyed JOIN f USING (group_id) GROUP BY ALL)
SELECT file, sum(n)::BIGINT AS total, count(*) FILTER (real) AS unique_keys, count(*) FILTER (real AND n > 1) AS clusters, coalesce(sum(n - 1) FILTER (real AND n > 1), 0)::BIGINT AS extra, count(*) FILTER (real AND n > 1 AND g > 1) AS across,
  coalesce(sum(n - 1) FILTER (real AND n > 1 AND g > 1), 0)::BIGINT AS across_extra, count(*) FILTER (real AND n > 1 AND g = 1) AS within, coalesce(sum(n - 1) FILTER (real AND n > 1 AND g = 1), 0)::BIGINT AS within_extra FROM k GROUP BY file""",
)
def file_report(spark, sf):
    return quality.file_report(questions(spark, sf), GROUP_FILES)


@query("option_repeats", "SELECT p_partkey, '3' AS places, false AS few FROM part")
def option_repeats(spark, sf):
    """Four options of which the last repeats the first."""
    rows = options_of(spark, sf)
    return rows.select("p_partkey", F.array_join(quality.later_repeats(F.col("options")).cast("array<string>"), ",").alias("places"), quality.few_options(F.lit("multi"), F.col("options")).alias("few"))


def digest(name: str, column, sql: str):
    """A query that returns the digest of one function over every document."""
    query(name, f"SELECT doc_id, md5({sql}) AS digest FROM documents")(lambda spark, sf: table(spark, sf, "documents").select("doc_id", F.md5(column()).alias("digest")))


SIDES_SQL = f"'^{BLANK_SQL}|{BLANK_SQL}$'"
digest("norm_full", lambda: text.norm_full(F.col("text"), F.array(F.struct(F.lit("A").alias("key"), F.col("source").alias("text")), F.struct(F.lit("B").alias("key"), F.col("lang").alias("text"))), F.col("lang")), f"{NORM_SQL} || '|a' || lower(source) || 'b' || lower(lang) || '|' || lower(lang)")
digest("clean_stem", lambda: text.clean_stem(F.expr("concat(' [来源：x.md] ', source, ' （ B ）  ', text, ' C')")), f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(source || ' （ B ）  ' || text || ' C', '{BLANK_SQL}', ' ', 'g'), '[（(]\\s*([A-E])\\s*[)）]', '', 'g'), '\\s+([A-E])$', ''), {SIDES_SQL}, '', 'g')")
digest("heading_ids", lambda: text.headings_with_ids(F.expr("concat('<h2>', source, ' ', lang, '</h2><p>', doc_id, '</p><h3>', lang, '</h3><h3><b>x</b></h3>')")), "'<h2 id=\"' || source || '-' || lang || '\">' || source || ' ' || lang || '</h2><p>' || doc_id || '</p><h3 id=\"' || lang || '\">' || lang || '</h3><h3><b>x</b></h3>'")
digest("normalized_sections", lambda: text.normalize_sections(F.expr("concat('  **考点**：', source, ' **标签**：a\n\n\n\n**拓展**：', lang, '\n\n\nz ')")), "'**考点**：' || source || chr(10) || chr(10) || '**标签**：a' || chr(10) || chr(10) || '**拓展**：' || lang || chr(10) || chr(10) || 'z'")
digest("answer_labels", lambda: text.labelled_answer(F.expr("CASE doc_id % 4 WHEN 0 THEN concat('**答案**：', lang) WHEN 1 THEN concat('**答案：', lang, '**') WHEN 2 THEN concat('** 答案 ** : ', lang, ' ') ELSE concat('答案：', lang) END")), "CASE WHEN doc_id % 4 < 3 THEN lang END")
digest("explicit_tags", lambda: F.array_join(text.explicit_tags(F.expr("concat('x\n**标签**：', source, ' · ', lang, '，a、, b \ny')")), "|"), "source || '|' || lang || '|a|b'")


@query(
    "enrichment_state",
    "SELECT doc_id, doc_id % 3 <> 0 OR doc_id % 2 = 0 AS eligible, doc_id % 4 = 1 AS valid, doc_id % 3 = 1 AS shares FROM documents",
)
def enrichment_state(spark, sf):
    explained = F.expr("CASE doc_id % 3 WHEN 0 THEN concat(source, '\n> ** 考点：x**') WHEN 1 THEN '**考点**' END")
    produced = F.expr("CASE doc_id % 4 WHEN 0 THEN '```\n**考点**\n```' WHEN 1 THEN concat('**考点**：', source) WHEN 2 THEN source END")
    reference = F.expr("CASE doc_id % 3 WHEN 0 THEN '無会' WHEN 1 THEN '会議' ELSE '海' END")
    return table(spark, sf, "documents").select("doc_id", prompts.is_eligible(explained, F.col("doc_id") % 2 == 0).alias("eligible"), text.valid_explanation(produced).alias("valid"), prompts.shares_reading(F.lit("会う"), reference).alias("shares"))


@query(
    "party_answers",
    """SELECT doc_id, ['single', 'multi', 'judgement', 'single', 'multi', 'skip'][doc_id % 6 + 1] AS kind, ['C', 'AB', '错误', 'B', 'BD', ''][doc_id % 6 + 1] AS normalized,
  ['single', 'multi', 'judgement', 'multi', 'multi', 'skip'][doc_id % 6 + 1] AS military_kind, ['C', 'AB', '错误', 'AB', 'BD', ''][doc_id % 6 + 1] AS military_normalized FROM documents""",
)
def party_answers(spark, sf):
    """Raw answers that letters, judgements and option texts explain."""
    options = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(t).alias("text")) for k, t in (("A", "长征"), ("B", "长征。 万里"), ("C", "x"), ("D", "y"))])
    raw = F.expr("element_at(array('c.', 'b、a', '错', '长征万里', '选 BD 项', '无'), cast(doc_id % 6 + 1 AS int))")
    military = F.expr("element_at(array('c.（见书）', 'b、a', '错（实质错误）', '长征。 万里和长征', '选 BD 项', '无'), cast(doc_id % 6 + 1 AS int))")
    one, two = answers.detect_answer(raw, options, variant="party"), answers.detect_answer(military, options, variant="military")
    return table(spark, sf, "documents").select("doc_id", one["kind"].alias("kind"), one["normalized"].alias("normalized"), two["kind"].alias("military_kind"), two["normalized"].alias("military_normalized"))


#: One text for every rule of the taggers, dealt to the documents by id.
SAMPLES = [pattern.split("|")[0].replace("[一大二三四大五六七大]", "一").replace("[一大二大三四十大]", "三").replace("[权利义务]", "权").replace("[中央基层纪律]", "中") for rules in (text.HISTORY_TAGS, text.PARTY_TAGS, text.MILITARY_TAGS) for _, pattern in rules]
SAMPLE = "element_at(array(" + ", ".join(f"'{s}'" for s in SAMPLES) + f"), cast(doc_id % {len(SAMPLES)} + 1 AS int))"


def tags_sql(rules, first: str) -> str:
    stem = f"([{', '.join(repr(s) for s in SAMPLES)}])[doc_id % {len(SAMPLES)} + 1] || text || ' 长征' || chr(10) || '**标签**：own·' || source"
    named = ", ".join(f"CASE WHEN regexp_matches(s, '{p}') THEN '{n}' END" for n, p in rules)
    return f"""WITH t AS (SELECT doc_id, source, {stem} AS s FROM documents), l AS (SELECT doc_id, list_filter([{first} CASE doc_id % 4 WHEN 0 THEN '多选题' WHEN 1 THEN '判断题' WHEN 2 THEN '单选题' ELSE '填空题' END, 'own', source, {named}], lambda x: x IS NOT NULL) AS l FROM t)
SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS tags FROM l"""


def tagged(name: str, rules, title=None, first: str = ""):
    def run(spark, sf):
        kind = F.expr("CASE doc_id % 4 WHEN 0 THEN 'multi' WHEN 1 THEN 'judgement' WHEN 2 THEN 'single' ELSE 'fill' END")
        explanation = F.concat(F.lit("长征\n**标签**：own·"), F.col("source"))
        found = text.question_tags(kind, F.concat(F.expr(SAMPLE), F.col("text")), explanation, rules, F.lit(title) if title else None)
        return table(spark, sf, "documents").select("doc_id", F.array_join(found, ",").alias("tags"))

    query(name, tags_sql(rules, first))(run)


tagged("history_tags", text.HISTORY_TAGS, "刷题单 第三套", "'第三章', ")
tagged("party_tags", text.PARTY_TAGS)
tagged("military_tags", text.MILITARY_TAGS)

#: Rules for readings, made for this query: a voiced first sign, a dropped small sign, another last sign, a longer end.
READING_RULES = [("^か", "が"), ("^さ", "ざ"), ("^た", "だ"), ("^は", "ば"), ("っ", ""), ("い$", "え"), ("う$", "お"), ("([^ん])$", "$1ん")]
LETTERS, SIGNS = "abcdefghijklmnopqrstuvwxyz ", "かきくけこさしすせいたっうてとなにぬはひふへほまみむん"


@query(
    "kana_alternatives",
    f"""WITH w AS (SELECT p_partkey, translate(p_name, '{LETTERS}', '{SIGNS}') AS word FROM part), c AS (
  SELECT *, [{", ".join(f"CASE WHEN regexp_matches(word, '{p}') THEN regexp_replace(word, '{p}', '{t.replace('$', chr(92))}', 'g') END" for p, t in READING_RULES)}] AS c,
    CASE WHEN p_partkey % 3 = 0 THEN [regexp_replace(word, '^か', 'が'), regexp_replace(word, '^さ', 'ざ'), regexp_replace(word, 'っ', '', 'g')] ELSE [] END AS taken FROM w)
SELECT p_partkey, word, coalesce(list_filter(c, lambda x: x IS NOT NULL AND x <> word AND NOT list_contains(taken, x) AND length(x) >= 2)[1], word || 'ー') AS altered FROM c""",
)
def kana_alternatives(spark, sf):
    """The names of parts as readings; for every third one, some alterations are taken."""
    word = F.translate("p_name", LETTERS, SIGNS)
    taken = F.when(F.col("p_partkey") % 3 == 0, F.array(F.regexp_replace(word, "^か", "が"), F.regexp_replace(word, "^さ", "ざ"), F.regexp_replace(word, "っ", ""))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf, "part").select("p_partkey", word.alias("word"), alternatives.altered_reading(word, taken, READING_RULES, 2).alias("altered"))


@query("kanji_alternatives", "SELECT doc_id, ['丹い', '三丹', '字書', NULL][doc_id % 4 + 1] AS altered FROM documents")
def kanji_alternatives(spark, sf):
    word = F.expr("element_at(array('丸い', '二丹', '本書', 'かな'), cast(doc_id % 4 + 1 AS int))")
    return table(spark, sf, "documents").select("doc_id", alternatives.lookalike(word, F.array(F.lit("九い")), {"丸": ["九", "丹"], "二": ["三"]}, ["字"]).alias("altered"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


@query(
    "enrichment_prompts",
    f"""WITH d AS (SELECT *, chr(10) || chr(10) AS gap, CASE WHEN length(text) > 30 THEN left(text, 30) || '…' ELSE text END AS cut FROM documents)
SELECT doc_id, md5('你是' || source || '考试题库的解析编写专家。请为下面的' || CASE doc_id % 3 WHEN 0 THEN '单选' WHEN 1 THEN '多选' ELSE '判断' END || '题生成结构化解析。' || gap || '【题干】' || chr(10) || text || gap || '【选项】' || chr(10)
  || 'A. ' || source || chr(10) || 'B. ' || text || chr(10) || 'C. z' || gap || '【正确答案】' || CASE doc_id % 3 WHEN 0 THEN 'A. ' || source WHEN 1 THEN 'C. z / A. ' || source ELSE 'X' END || gap || {_quoted(prompts.OUTPUT_FORM)}
  || CASE WHEN doc_id % 3 = 2 THEN {_quoted(prompts.JUDGEMENT_FORM)} ELSE {_quoted(prompts.CHOICE_FORM)} || '- B. ' || cut || {_quoted(prompts.WHY_WRONG)} || CASE WHEN doc_id % 3 = 0 THEN chr(10) || '- C. z' || {_quoted(prompts.WHY_WRONG)} ELSE '' END || {_quoted(prompts.EXTENSION)} END || gap || {_quoted(prompts.DEMANDS)}) AS prompt FROM d""",
)
def enrichment_prompts(spark, sf):
    options = F.array(*[F.struct(F.lit(k).alias("key"), t.alias("text")) for k, t in (("A", F.col("source")), ("B", F.col("text")), ("C", F.lit("z")))])
    kind = F.expr("CASE doc_id % 3 WHEN 0 THEN 'single' WHEN 1 THEN 'multi' ELSE 'judgement' END")
    right = F.expr("CASE doc_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'CA' ELSE 'X' END")
    return table(spark, sf, "documents").select("doc_id", F.md5(prompts.enrichment_prompt(kind, F.col("text"), options, right, F.col("source"))).alias("prompt"))
