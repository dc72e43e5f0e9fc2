"""Registered queries: list views, pools in every mode, histories, sessions and sub-banks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tallyloom.functions import answers, numbers, prompts, text
from tallyloom.operators import analytics, quality, retrieval, scheduler, state
from tallyloom.operators.ordering import ranked
from tallyloom.plans.content import KEYED_SQL
from tallyloom.plans.learning import PERCENT_SQL, TODAY
from tallyloom.sources import banks
from tallyloom.sources.tables import ATTEMPTS_SQL, MODEL_SQL, QUESTIONS_SQL, attempts, questions, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return register


def strip_sql(x: str) -> str:
    for pattern, new in (("\\*\\*([^*]+?)\\*\\*", "\\1"), ("\\*([^*]+?)\\*", "\\1"), ("`([^`]+?)`", "\\1"), ("\\[([^\\]]+?)\\]\\([^)]+?\\)", "\\1"), ("\\n", " ")):
        x = f"regexp_replace({x}, '{pattern}', '{new}', 'g')"
    return x


def cut_sql(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) <= {n} THEN {x} ELSE left({x}, {n}) || '…' END"


def states(spark, sf):
    return state.question_stats(attempts(spark, sf))


WRONG_SQL = "wrong_count > 0 AND (wrong_count >= correct_count OR mastery <= 2)"


def by_order(rows, orders):
    """One ranked list for each order."""
    return reduce(lambda a, b: a.unionByName(b), [retrieval.listed(rows, order).select(F.lit(order).alias("list"), "*") for order in orders])


@query(
    "wrong_book",
    f"""{MODEL_SQL}, w AS (SELECT question_id, wrong_count, last_attempt_at, coalesce(group_title, '') AS "group" FROM stats LEFT JOIN questions ON question_id = id AND status = 'ready' WHERE {WRONG_SQL})
SELECT 'all' AS list, question_id, "group", row_number() OVER (ORDER BY question_id) AS rank FROM w
UNION ALL SELECT 'most-wrong', question_id, "group", row_number() OVER (ORDER BY wrong_count DESC, question_id) FROM w
UNION ALL SELECT 'recent', question_id, "group", row_number() OVER (ORDER BY last_attempt_at DESC, question_id) FROM w""",
)
def wrong_book(spark, sf):
    wrong = retrieval.with_questions(scheduler.wrong_questions(states(spark, sf)), questions(spark, sf).where("status = 'ready'"))
    return by_order(wrong, ("all", "most-wrong", "recent")).select("list", "question_id", "group", "rank")


@query(
    "bookmark_lists",
    f"""{MODEL_SQL}, b AS (SELECT id AS question_id, coalesce(mastery, 0) AS mastery, last_attempt_at FROM questions LEFT JOIN stats ON question_id = id WHERE group_id = 'src1')
SELECT 'all' AS list, question_id, row_number() OVER (ORDER BY question_id) AS rank FROM b
UNION ALL SELECT 'recent', question_id, row_number() OVER (ORDER BY last_attempt_at DESC NULLS LAST, question_id) FROM b
UNION ALL SELECT 'mastered', question_id, row_number() OVER (ORDER BY question_id) FROM b WHERE mastery >= 4""",
)
def bookmark_lists(spark, sf):
    marked = questions(spark, sf).where("group_id = 'src1'").select(F.col("id").alias("question_id"))
    rows = state.bookmark(states(spark, sf), marked)
    mastered = retrieval.listed(retrieval.bookmarked(rows, mastered_only=True), "all").select(F.lit("mastered").alias("list"), "*")
    return by_order(retrieval.bookmarked(rows), ("all", "recent")).unionByName(mastered).select("list", "question_id", "rank")


@query(
    "top_wrong",
    f"""{MODEL_SQL}, w AS (SELECT *, row_number() OVER (ORDER BY wrong_count DESC, question_id) AS rank FROM stats WHERE wrong_count > 0 QUALIFY rank <= 10), s AS (SELECT id, {strip_sql("stem")} AS s FROM questions)
SELECT rank, question_id, {cut_sql("coalesce(s, '')", 50)} AS stem, wrong_count, {PERCENT_SQL.format(a="correct_count", b="attempt_count")} AS rate FROM w LEFT JOIN s ON id = question_id""",
)
def top_wrong(spark, sf):
    return retrieval.top_wrong(states(spark, sf), questions(spark, sf))


@query(
    "attempt_items",
    f"""WITH {ATTEMPTS_SQL}, {QUESTIONS_SQL}, s AS (SELECT id, group_title, {strip_sql("stem")} AS s FROM questions WHERE status = 'ready')
SELECT attempt_id, question_id, CASE WHEN id IS NULL THEN question_id::VARCHAR ELSE {cut_sql("s", 40)} END AS stem, coalesce(group_title, '') AS "group" FROM attempts LEFT JOIN s ON id = question_id""",
)
def attempt_items(spark, sf):
    return retrieval.item_info(attempts(spark, sf).select("attempt_id", "question_id"), questions(spark, sf).where("status = 'ready'"))


@query(
    "session_results",
    f"""WITH {ATTEMPTS_SQL}, {QUESTIONS_SQL}, e AS (SELECT a.*, event_type AS selected FROM attempts a JOIN events ON attempt_id = event_id),
l AS (SELECT learner_id, question_id, arg_max(is_correct, (created_at, attempt_id)) AS ok, arg_min(selected, (created_at, attempt_id)) AS selected FROM e GROUP BY ALL), s AS (SELECT id, {strip_sql("stem")} AS s FROM questions)
SELECT learner_id AS session_id, question_id AS position, question_id, md5({cut_sql("s", 80)}) AS stem, selected FROM l JOIN s ON id = question_id WHERE NOT ok""",
)
def session_results(spark, sf):
    chosen = table(spark, sf, "events").select(F.col("event_id").alias("attempt_id"), F.col("event_type").alias("selected"))
    answered = attempts(spark, sf).join(chosen, "attempt_id").withColumnRenamed("learner_id", "session_id")
    latest = state.latest_answers(answered.withColumn("position", F.col("question_id")))
    session = latest.select("session_id", "position", "question_id", (~F.col("is_correct")).alias("is_wrong"))
    return retrieval.session_results(session, answered, questions(spark, sf)).withColumn("stem", F.md5("stem"))


@query("page_of_index", "SELECT doc_id, doc_id // 100 AS page, doc_id // 100 * 100 AS start, least(doc_id // 100 * 100 + 100, 123456789) AS \"end\" FROM documents")
def page_of_index(spark, sf):
    return table(spark, sf, "documents").select("doc_id", retrieval.page_of(F.col("doc_id"), F.lit(123456789).cast("bigint")).alias("p")).select("doc_id", "p.*")


@query("locale_order", "WITH g AS (SELECT source AS group_id FROM documents UNION SELECT upper(source) FROM documents) SELECT group_id, row_number() OVER (ORDER BY lower(group_id), group_id DESC) AS rank FROM g")
def locale_order(spark, sf):
    """Both cases of each group: the locale puts `a` before `A` before `b`."""
    docs = table(spark, sf, "documents")
    return retrieval.in_locale_order(docs.select(F.explode(F.array("source", F.upper("source"))).alias("group_id")).distinct())


@query("clusters_by_size", f"WITH {QUESTIONS_SQL}, {KEYED_SQL}, c AS (SELECT key, count(*) AS copies FROM keyed GROUP BY key HAVING count(*) > 1) SELECT key, copies, row_number() OVER (ORDER BY copies DESC, key) AS rank FROM c")
def clusters_by_size(spark, sf):
    return ranked(quality.clusters(questions(spark, sf)).select("key", "copies"), [F.desc("copies"), F.asc("key")])


SUB_BANKS = [("first", ["src1", "src3"]), ("second", ["src2", "none", "src9"]), ("empty", ["none"])]


@query("sub_bank_counts", "WITH b(name, groups, listed) AS (VALUES ('first', 2, ['src1', 'src3']), ('second', 3, ['src2', 'none', 'src9']), ('empty', 1, ['none'])) SELECT name, groups::BIGINT AS groups, count(doc_id) AS questions FROM b LEFT JOIN documents ON list_contains(listed, source) GROUP BY ALL")
def sub_bank_counts(spark, sf):
    return retrieval.sub_bank_counts(questions(spark, sf), spark.createDataFrame(SUB_BANKS, "name string, groups array<string>"))


IN_ORDER = ["src3", "src1", "src9"]
IN_ORDER_SQL = "list_position(['src3', 'src1', 'src9'], group_id)"


@query("sub_bank_wrong", f"{MODEL_SQL} SELECT id, group_id, row_number() OVER (ORDER BY {IN_ORDER_SQL}, wrong_count DESC, id) AS rank FROM questions JOIN stats ON id = question_id WHERE {WRONG_SQL} AND group_id IN ('src1', 'src3', 'src9')")
def sub_bank_wrong(spark, sf):
    wrong = scheduler.wrong_questions(states(spark, sf)).select(F.col("question_id").alias("id"), "wrong_count")
    return retrieval.sub_bank_ids(questions(spark, sf), wrong, IN_ORDER, [F.desc("wrong_count"), F.asc("id")])


@query("sub_bank_untouched", f"{MODEL_SQL} SELECT id, group_id, row_number() OVER (ORDER BY {IN_ORDER_SQL}, position) AS rank FROM questions WHERE id NOT IN (SELECT question_id FROM stats) AND group_id IN ('src1', 'src3', 'src9')")
def sub_bank_untouched(spark, sf):
    q = questions(spark, sf)
    return retrieval.sub_bank_ids(q, scheduler.untouched(q, states(spark, sf)).select("id"), IN_ORDER, [F.asc("position")])


@query("group_lists", f"{MODEL_SQL} SELECT group_id, 'wrong' AS list, id FROM questions JOIN stats ON id = question_id WHERE {WRONG_SQL} UNION ALL SELECT group_id, 'untouched', id FROM questions WHERE id NOT IN (SELECT question_id FROM stats)")
def group_lists(spark, sf):
    """The lists of a group card, as rows: a group may have any number of questions."""
    q, s = questions(spark, sf), states(spark, sf)
    wrong = q.join(scheduler.wrong_questions(s), F.col("id") == F.col("question_id"), "left_semi")
    both = wrong.select("group_id", F.lit("wrong").alias("list"), "id")
    return both.unionByName(scheduler.untouched(q, s).select("group_id", F.lit("untouched").alias("list"), "id"))


@query("group_type_report", f"WITH {QUESTIONS_SQL} SELECT group_id, nullif(count(*) FILTER (status = 'ready'), 0) AS ready, nullif(count(*) FILTER (status = 'review'), 0) AS review FROM questions GROUP BY group_id")
def group_type_report(spark, sf):
    return questions(spark, sf).groupBy("group_id").pivot("status", ["ready", "review"]).count()


@query("number_lists", f"WITH {QUESTIONS_SQL} SELECT group_id, position AS number, row_number() OVER (PARTITION BY group_id ORDER BY position) AS place FROM questions")
def number_lists(spark, sf):
    return quality.number_lists(questions(spark, sf), "position")


@query("total_questions", "SELECT count(*) AS total FROM documents WHERE lang IN ('en', 'fr', 'de', 'es')")
def total_questions(spark, sf):
    return banks.sidecar_or_count(None, questions(spark, sf), ["en", "fr", "de", "es", "xx"]).agg(F.sum("questions").alias("total"))


@query(
    "session_accuracy",
    f"""WITH {ATTEMPTS_SQL}, l AS (SELECT learner_id, question_id, arg_max(is_correct, (created_at, attempt_id)) AS ok FROM attempts GROUP BY ALL)
SELECT learner_id AS session_id, CAST(floor(count(*) FILTER (ok) / count(*) * 100 + 0.5) AS BIGINT) AS accuracy FROM l GROUP BY learner_id""",
)
def session_accuracy(spark, sf):
    answered = attempts(spark, sf).select(F.col("learner_id").alias("session_id"), F.col("question_id").alias("position"), "question_id", "is_correct", "place")
    return state.session_accuracy(state.session_totals(answered)).select("session_id", "accuracy")


@query("session_progress", "SELECT event_id, event_id % 7 + CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS current, 7::BIGINT AS total, event_id % 3 AS correct, event_id % 5 AS answered FROM events")
def session_progress(spark, sf):
    i = F.col("event_id")
    progress = retrieval.session_progress(i % 7, i % 2 == 0, F.lit(7).cast("bigint"), i % 3, i % 5)
    return table(spark, sf, "events").select("event_id", progress.alias("p")).select("event_id", "p.*")


@query(
    "document_states",
    """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'correct' WHEN 1 THEN 'wrong' WHEN 2 THEN 'draft' ELSE 'unanswered' END AS cell,
  CASE WHEN doc_id % 101 >= 70 THEN 'green' WHEN doc_id % 101 >= 40 THEN 'amber' ELSE 'red' END AS color,
  CASE doc_id % 5 WHEN 0 THEN '判断题' WHEN 1 THEN '多选题' WHEN 2 THEN '单选题' WHEN 3 THEN '填空题' ELSE '' END AS type_label,
  CASE doc_id % 6 WHEN 0 THEN 1 WHEN 1 THEN 10 WHEN 2 THEN 12 WHEN 3 THEN 19 WHEN 4 THEN 8 END::BIGINT AS chapter,
  CASE WHEN doc_id % 3 = 0 THEN 'anthropic' ELSE 'openai' END AS dialect FROM documents""",
)
def document_states(spark, sf):
    i = F.col("doc_id")
    correct = F.when(i % 4 == 0, True).when(i % 4 == 1, False)
    kind = F.expr("CASE doc_id % 5 WHEN 0 THEN 'judgement' WHEN 1 THEN 'multi' WHEN 2 THEN 'single' WHEN 3 THEN 'fill' ELSE 'other' END")
    chapter = F.expr("CASE doc_id % 6 WHEN 0 THEN '一' WHEN 1 THEN '十' WHEN 2 THEN '十二' WHEN 3 THEN '十九' WHEN 4 THEN '八' ELSE '百' END")
    url = F.expr("CASE WHEN doc_id % 3 = 0 THEN 'https://api.anthropic.example/v1' WHEN doc_id % 3 = 1 THEN 'https://x.example' END")
    return table(spark, sf, "documents").select("doc_id", answers.cell_status(correct, F.when(i % 4 == 2, "A")).alias("cell"), numbers.rate_color(i % 101).alias("color"), answers.type_label(kind).alias("type_label"), text.chinese_number(chapter).alias("chapter"), prompts.api_dialect(url).alias("dialect"))


@query("bank_states", f"{MODEL_SQL} SELECT question_id, mastery FROM stats WHERE question_id IN (SELECT id FROM questions WHERE category = 'en')")
def bank_states(spark, sf):
    return analytics.visible_states(states(spark, sf), questions(spark, sf).where("category = 'en'")).select("question_id", "mastery")


def typed(spark, sf):
    return questions(spark, sf).withColumn("question_type", F.expr("CASE id % 3 WHEN 0 THEN 'multi' WHEN 1 THEN 'fill' ELSE 'single' END"))


def pooled(spark, sf, **options):
    rows = retrieval.pool(typed(spark, sf), states(spark, sf), **options)
    return ranked(rows.select("id", "pool_order"), [F.asc("pool_order")]).select("id", "rank")


SOME_IDS = [5, 3, 8, 41, 900000000]


@query("pool_tag", f"WITH {QUESTIONS_SQL} SELECT id, row_number() OVER (ORDER BY position) AS rank FROM questions WHERE list_contains(tags, 'src4') OR list_contains(grammar_points, 'src4')")
def pool_tag(spark, sf):
    """A tag overrules the ids, the mode and the shuffling."""
    return pooled(spark, sf, tag="src4", ids=SOME_IDS, mode="exam", shuffle=True)


@query("pool_ids", f"WITH {QUESTIONS_SQL} SELECT id, row_number() OVER (ORDER BY position) AS rank FROM questions WHERE id IN (3, 5, 8, 41)")
def pool_ids(spark, sf):
    """Ids turn an exam into a list of just these, unshuffled."""
    return pooled(spark, sf, ids=SOME_IDS, mode="exam")


@query("pool_ids_weakness", f"WITH {QUESTIONS_SQL} SELECT id, row_number() OVER (ORDER BY md5('5/' || id)) AS rank FROM questions WHERE id IN (3, 5, 8, 41)")
def pool_ids_weakness(spark, sf):
    return pooled(spark, sf, ids=SOME_IDS, mode="weakness", shuffle=True, seed="5")


@query("pool_type", f"WITH {QUESTIONS_SQL} SELECT id, row_number() OVER (ORDER BY position) AS rank FROM questions WHERE id % 3 = 1 AND group_id IN ('src2', 'src6')")
def pool_type(spark, sf):
    return pooled(spark, sf, question_type="fill", groups=["src2", "src6"])


@query("pool_random", f"WITH {QUESTIONS_SQL} SELECT id, row_number() OVER (ORDER BY md5('11/' || id)) AS rank FROM questions WHERE group_id = 'src5'")
def pool_random(spark, sf):
    return pooled(spark, sf, groups=["src5"], mode="random", seed="11")


@query("pool_wrong", f"WITH {QUESTIONS_SQL} SELECT id, row_number() OVER (ORDER BY md5('2/' || id)) AS rank FROM questions WHERE group_id = 'src1'")
def pool_wrong(spark, sf):
    return pooled(spark, sf, groups=["src1"], mode="wrong", shuffle=True, seed="2")


@query("pool_untouched", f"WITH {QUESTIONS_SQL} SELECT id, row_number() OVER (ORDER BY position) AS rank FROM questions WHERE id IN (3, 5, 8, 41)")
def pool_untouched(spark, sf):
    return pooled(spark, sf, ids=SOME_IDS, mode="untouched")


HISTORY_SQL = "WITH " + ATTEMPTS_SQL + ", l AS (SELECT * FROM attempts ORDER BY created_at DESC, attempt_id DESC LIMIT 1000) SELECT attempt_id, question_id FROM l WHERE {}"


@query("history_today", HISTORY_SQL.format(f"created_at >= TIMESTAMP '{TODAY}'"))
def history_today(spark, sf):
    return analytics.history(attempts(spark, sf), "today", TODAY).select("attempt_id", "question_id")


@query("history_month_correct", HISTORY_SQL.format(f"is_correct AND created_at >= TIMESTAMP '{TODAY}' - INTERVAL 30 DAY"))
def history_month_correct(spark, sf):
    return analytics.history(attempts(spark, sf), "month", TODAY, "correct").select("attempt_id", "question_id")


@query("history_all_wrong", HISTORY_SQL.format("NOT is_correct"))
def history_all_wrong(spark, sf):
    return analytics.history(attempts(spark, sf), "all", TODAY, "wrong").select("attempt_id", "question_id")


@query(
    "toggle_letters",
    """WITH e AS (SELECT event_id, ['', 'A', 'AC', 'DB'][event_id % 4 + 1] AS c, ['A', 'B', 'D'][event_id % 3 + 1] AS k FROM events)
SELECT event_id, array_to_string(list_sort(CASE WHEN contains(c, k) THEN list_filter(string_split(c, ''), lambda x: x <> k AND x <> '') ELSE list_append(list_filter(string_split(c, ''), lambda x: x <> ''), k) END), '') AS letters FROM e""",
)
def toggle_letters(spark, sf):
    current = F.expr("element_at(array('', 'A', 'AC', 'DB'), cast(event_id % 4 + 1 AS int))")
    key = F.expr("element_at(array('A', 'B', 'D'), cast(event_id % 3 + 1 AS int))")
    return table(spark, sf, "events").select("event_id", answers.toggle_letter(current, key).alias("letters"))


@query(
    "chat_request",
    """WITH r AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations)
SELECT conv_id, count(*) + 2 AS messages, md5('system:be brief' || chr(10) || string_agg(role || ':' || coalesce(text, '') || chr(10), '' ORDER BY turn) || 'user:why?') AS digest FROM r WHERE back <= 10 GROUP BY conv_id""",
)
def chat_request(spark, sf):
    asked = retrieval.chat_request(table(spark, sf, "conversations").select("conv_id", "turn", "role", "text"), F.lit("be brief"), F.lit("why?"))
    said = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), F.coalesce(m["content"], F.lit("")))), "\n")
    return asked.select("conv_id", F.size("messages").cast("bigint").alias("messages"), F.md5(said).alias("digest"))


@query("append_attempts", f"WITH {ATTEMPTS_SQL} SELECT question_id, count(*) AS attempts FROM (SELECT * FROM attempts UNION ALL SELECT * FROM attempts WHERE attempt_id % 3 = 0) GROUP BY question_id")
def append_attempts(spark, sf):
    """An import adds its attempts to those at hand and removes no repeats."""
    a = attempts(spark, sf)
    return state.append(a, a.where("attempt_id % 3 = 0").drop("elapsed_ms")).groupBy("question_id").agg(F.count("*").alias("attempts"))


@query("clear_all", "SELECT 'settings' AS name, count(*) AS rows FROM region WHERE r_name <> 'ASIA' UNION ALL SELECT 'attempts', 0")
def clear_all(spark, sf):
    settings = table(spark, sf, "region").select(F.col("r_name").alias("key"), F.col("r_comment").alias("value") if "r_comment" in table(spark, sf, "region").columns else F.lit("v").alias("value"))
    left = state.clear({"settings": settings, "attempts": attempts(spark, sf)}, session_key="ASIA")
    return reduce(lambda a, b: a.unionByName(b), [rows.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows") for name, rows in left.items()])


@query("backup_restore", f"{MODEL_SQL} SELECT 'questionStats' AS name, count(*) AS rows, sum(attempt_count)::BIGINT AS total FROM stats UNION ALL SELECT 'tagStats', 0, NULL UNION ALL SELECT 'settings', count(*), NULL FROM region")
def backup_restore(spark, sf):
    """A backup of all states and of no tags, over a half of the states and some tags; settings are not in it and stay."""
    s = states(spark, sf)
    tags = state.tag_stats(attempts(spark, sf), questions(spark, sf))
    exported = banks.export_all({"questionStats": s, "tagStats": tags.limit(0)}, F.lit("2024-02-03").cast("timestamp"))
    settings = table(spark, sf, "region").select(F.col("r_name").alias("key"))
    left = banks.import_all(exported, {"questionStats": s.where("question_id % 2 = 0"), "tagStats": tags, "settings": settings})
    total = lambda name: F.sum("attempt_count") if name != "settings" else F.lit(None).cast("bigint")
    return reduce(lambda a, b: a.unionByName(b), [rows.agg(F.count("*").alias("rows"), total(name).alias("total")).select(F.lit(name).alias("name"), "rows", "total") for name, rows in left.items()])
