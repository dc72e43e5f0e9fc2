"""Registered queries: learning state, scheduler, analytics, streaks, state exchange."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import numbers, schedule
from tallyloom.operators import analytics, scheduler, state, streaks
from tallyloom.operators.ordering import ranked
from tallyloom.sources.tables import ATTEMPTS_SQL, MODEL_SQL, QUESTIONS_SQL, attempts, questions, table

#: Fixed dates of the fixture: its last day, and a time when some reviews are due and others not.
TODAY = "2024-01-30"
NOW = "2024-02-03 00:00:00"

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return register


def model(spark, sf):
    a, q = attempts(spark, sf), questions(spark, sf)
    return a, q, state.question_stats(a)


STATE_COLUMNS = "question_id, attempt_count, correct_count, wrong_count, mastery, last_correct, last_attempt_at"


@query("question_stats", f"{MODEL_SQL} SELECT {STATE_COLUMNS}, review_due_at, bookmarked FROM stats")
def question_stats(spark, sf):
    return state.question_stats(attempts(spark, sf))


@query("stats_fold", f"{MODEL_SQL} SELECT {STATE_COLUMNS} FROM stats")
def stats_fold(spark, sf):
    return state.fold(attempts(spark, sf).withColumn("redo", F.lit(False)), "question_id")


@query(
    "stats_fold_redo",
    f"""WITH RECURSIVE {ATTEMPTS_SQL}, a AS MATERIALIZED (SELECT *, attempt_id % 2 = 0 AS redo, row_number() OVER (PARTITION BY learner_id, question_id ORDER BY created_at, attempt_id) AS n FROM attempts),
f AS (
  SELECT learner_id, question_id, n, 1::BIGINT AS attempt_count, is_correct::BIGINT AS correct_count, 0::BIGINT AS wrong_count, CASE WHEN NOT is_correct THEN 1 WHEN redo THEN 3 ELSE 2 END::BIGINT AS mastery, is_correct AS last_correct, created_at AS last_attempt_at FROM a WHERE n = 1
  UNION ALL
  SELECT a.learner_id, a.question_id, a.n, attempt_count + 1, correct_count + a.is_correct::BIGINT, CASE WHEN a.redo AND a.is_correct THEN 0 ELSE wrong_count + (NOT a.is_correct)::BIGINT END,
    CASE WHEN NOT a.is_correct THEN 1 WHEN a.redo THEN greatest(3, least(5, mastery + 1)) WHEN mastery < 1 THEN 2 ELSE least(5, mastery + 1) END::BIGINT, a.is_correct, a.created_at
  FROM f JOIN a ON f.learner_id = a.learner_id AND f.question_id = a.question_id AND a.n = f.n + 1
)
SELECT * EXCLUDE (n) FROM f QUALIFY row_number() OVER (PARTITION BY learner_id, question_id ORDER BY n DESC) = 1""",
)
def stats_fold_redo(spark, sf):
    """Every second attempt of a learner's question in redo mode, which has no closed form: the SQL goes attempt by attempt."""
    return state.fold(attempts(spark, sf).withColumn("redo", F.col("attempt_id") % 2 == 0), "learner_id", "question_id")


@query("tag_stats", f"{MODEL_SQL} SELECT * FROM tag_stats")
def tag_stats(spark, sf):
    return state.tag_stats(attempts(spark, sf), questions(spark, sf))


@query(
    "group_analysis",
    f"""{MODEL_SQL}, g AS (
  SELECT group_id, arg_min(group_title, position) AS title, count(*) AS total, count(*) FILTER (attempt_count > 0) AS done,
    coalesce(sum(correct_count), 0)::BIGINT AS correct, coalesce(sum(wrong_count), 0)::BIGINT AS wrong
  FROM questions LEFT JOIN stats ON id = question_id GROUP BY group_id
) SELECT *, CASE WHEN done > 0 THEN CAST(floor(correct / nullif(correct + wrong, 0) * 100 + 0.5) AS BIGINT) ELSE 0 END AS rate FROM g""",
)
def group_analysis(spark, sf):
    _, q, s = model(spark, sf)
    return analytics.group_analysis(q, s)


PERCENT_SQL = "CASE WHEN {b} > 0 THEN CAST(floor({a} / {b} * 100 + 0.5) AS BIGINT) ELSE 0 END"


@query(
    "group_cards",
    f"""{MODEL_SQL}, v AS (SELECT * FROM questions WHERE status = 'ready'), c AS (
  SELECT group_id, count(*) FILTER (coalesce(attempt_count, 0) > 0) AS done, sum(coalesce(attempt_count, 0)) AS attempts, sum(coalesce(correct_count, 0)) AS correct,
    count(*) FILTER (coalesce(wrong_count, 0) > 0) AS wrong, count(*) FILTER (coalesce(attempt_count, 0) = 0) AS untouched
  FROM v LEFT JOIN stats ON id = question_id GROUP BY group_id
), t AS (SELECT group_id, count(*) AS total FROM questions GROUP BY group_id)
SELECT group_id, total, coalesce(done, 0) AS done, coalesce(attempts, 0)::BIGINT AS attempts, coalesce(correct, 0)::BIGINT AS correct, coalesce(wrong, 0) AS wrong, coalesce(untouched, 0) AS untouched FROM t LEFT JOIN c USING (group_id)""",
)
def group_cards(spark, sf):
    _, q, s = model(spark, sf)
    return analytics.group_cards(q, s, q.where("status = 'ready'"))


@query(
    "tag_analysis",
    f"""{MODEL_SQL}, p AS (SELECT position, grammar_points, unnest(range(1, len(grammar_points) + 1)) AS i FROM questions),
c AS (SELECT grammar_points[i] AS name, count(*) AS n, min(position * 1000 + i) AS first FROM p GROUP BY name),
top AS (SELECT * FROM c ORDER BY n DESC, first LIMIT 15),
idx AS (SELECT id, unnest(list_concat(grammar_points, tags)) AS name FROM questions),
s AS (SELECT name, count(*) AS questions, coalesce(sum(attempt_count), 0)::BIGINT AS attempts, coalesce(sum(correct_count), 0)::BIGINT AS correct FROM idx LEFT JOIN stats ON id = question_id GROUP BY name)
SELECT row_number() OVER (ORDER BY n DESC, first) AS rank, name, questions, attempts, {PERCENT_SQL.format(a="correct", b="attempts")} AS rate FROM top JOIN s USING (name)""",
)
def tag_analysis(spark, sf):
    _, q, s = model(spark, sf)
    return analytics.tag_analysis(q, s)


@query(
    "top_tags",
    f"""WITH {QUESTIONS_SQL}, p AS (SELECT position, tags, unnest(range(1, len(tags) + 1)) AS i FROM questions),
c AS (SELECT tags[i] AS name, count(*) AS questions, min(position * 1000 + i - 1) AS first FROM p GROUP BY name)
SELECT * FROM c ORDER BY questions DESC, first LIMIT 20""",
)
def top_tags(spark, sf):
    return analytics.top_tags(questions(spark, sf), "tags", 20)


@query(
    "group_counts",
    f"""WITH {QUESTIONS_SQL} SELECT group_id, arg_min(group_title, position) AS title, count(*) AS questions, min(position) AS first FROM questions GROUP BY group_id""",
)
def group_counts(spark, sf):
    return questions(spark, sf).groupBy("group_id").agg(F.min_by("group_title", "position").alias("title"), F.count("*").alias("questions"), F.min("position").alias("first"))


@query(
    "overall",
    f"""{MODEL_SQL}, s AS (SELECT count(*) FILTER (attempt_count > 0) AS done, sum(attempt_count)::BIGINT AS attempts, sum(correct_count)::BIGINT AS correct, count(*) FILTER (wrong_count > 0) AS wrong_questions FROM stats)
SELECT (SELECT count(*) FROM questions) AS total, done, attempts, correct, wrong_questions, {PERCENT_SQL.format(a="correct", b="attempts")} AS rate FROM s""",
)
def overall(spark, sf):
    _, q, s = model(spark, sf)
    return analytics.overall(q, s)


@query(
    "mastery_summary",
    f"""{MODEL_SQL} SELECT count(*) FILTER (mastery >= 4) AS mastered, count(*) FILTER (mastery IN (2, 3)) AS learning, count(*) FILTER (mastery < 2) AS weak,
  (SELECT count(*) FROM questions) - count(*) FILTER (attempt_count > 0) AS untouched FROM stats""",
)
def mastery_summary(spark, sf):
    _, q, s = model(spark, sf)
    return analytics.mastery_summary(q, s)


@query(
    "category_progress",
    f"""{MODEL_SQL}, c AS (SELECT category, count(*) AS total, count(*) FILTER (attempt_count > 0) AS done, coalesce(sum(attempt_count), 0)::BIGINT AS attempts, coalesce(sum(correct_count), 0)::BIGINT AS correct
  FROM questions LEFT JOIN stats ON id = question_id GROUP BY category)
SELECT category, total, done, attempts, {PERCENT_SQL.format(a="correct", b="attempts")} AS rate, {PERCENT_SQL.format(a="done", b="total")} AS progress FROM c""",
)
def category_progress(spark, sf):
    _, q, s = model(spark, sf)
    return analytics.category_progress(q, s)


@query(
    "speed",
    f"""WITH {ATTEMPTS_SQL}, v AS (SELECT * FROM attempts WHERE elapsed_ms > 0 AND elapsed_ms < 300000)
SELECT CAST(floor(avg(elapsed_ms) + 0.5) AS BIGINT) AS avg_ms, CAST(floor(avg(elapsed_ms) FILTER (is_correct) + 0.5) AS BIGINT) AS avg_correct_ms, CAST(floor(avg(elapsed_ms) FILTER (NOT is_correct) + 0.5) AS BIGINT) AS avg_wrong_ms,
  min(elapsed_ms) AS fastest_ms, (SELECT attempt_id FROM v ORDER BY elapsed_ms, created_at, attempt_id LIMIT 1) AS fastest_id,
  max(elapsed_ms) AS slowest_ms, (SELECT attempt_id FROM v ORDER BY elapsed_ms DESC, created_at DESC, attempt_id DESC LIMIT 1) AS slowest_id FROM v""",
)
def speed(spark, sf):
    return analytics.speed(attempts(spark, sf))


@query("trend", f"WITH {ATTEMPTS_SQL}, l AS (SELECT * FROM attempts ORDER BY created_at DESC, attempt_id DESC LIMIT 40), c AS (SELECT count(*) AS total, count(*) FILTER (is_correct) AS correct FROM l) SELECT *, {PERCENT_SQL.format(a='correct', b='total')} AS rate FROM c")
def trend(spark, sf):
    return analytics.trend(attempts(spark, sf))


@query(
    "recent_rate",
    f"""WITH {ATTEMPTS_SQL}, {QUESTIONS_SQL}, l AS (SELECT * FROM attempts ORDER BY created_at DESC, attempt_id DESC LIMIT 500),
b AS (SELECT * FROM l WHERE question_id IN (SELECT id FROM questions WHERE category = 'en') ORDER BY created_at DESC, attempt_id DESC LIMIT 30),
c AS (SELECT count(*) AS total, count(*) FILTER (is_correct) AS ok FROM b) SELECT total, {PERCENT_SQL.format(a='ok', b='total')} AS rate FROM c""",
)
def recent_rate(spark, sf):
    return analytics.recent_rate(attempts(spark, sf), questions(spark, sf).where("category = 'en'"))


HEATMAP_SQL = f"""{ATTEMPTS_SQL}, days AS (SELECT CAST(unnest(generate_series(DATE '{TODAY}' - 29, DATE '{TODAY}', INTERVAL 1 DAY)) AS DATE) AS day),
c AS (SELECT CAST(created_at AS DATE) AS day, count(*) AS n FROM attempts GROUP BY 1),
h AS (SELECT day, coalesce(n, 0) AS attempts, CASE WHEN n >= 16 THEN 3 WHEN n >= 6 THEN 2 WHEN n >= 1 THEN 1 ELSE 0 END::BIGINT AS level FROM days LEFT JOIN c USING (day))"""


@query("heatmap", f"WITH {HEATMAP_SQL} SELECT * FROM h")
def heatmap(spark, sf):
    return analytics.heatmap(attempts(spark, sf), TODAY)


@query("heatmap_summary", f"WITH {HEATMAP_SQL} SELECT count(*) FILTER (attempts > 0) AS active_days, max(attempts) AS max_attempts FROM h")
def heatmap_summary(spark, sf):
    return analytics.heatmap_summary(analytics.heatmap(attempts(spark, sf), TODAY))


@query("daily_count", f"WITH {ATTEMPTS_SQL} SELECT count(*) AS attempts FROM attempts WHERE created_at >= TIMESTAMP '2024-01-15' AND created_at < TIMESTAMP '2024-01-16'")
def daily_count(spark, sf):
    return analytics.attempts_on(attempts(spark, sf), "2024-01-15")


@query("daily_goal", f"WITH {ATTEMPTS_SQL}, d AS (SELECT CAST(created_at AS DATE) AS day, count(*) AS done FROM attempts GROUP BY 1) SELECT day, done, least(100, CAST(floor(done / 300 * 100 + 0.5) AS BIGINT)) AS progress, CASE WHEN least(100, floor(done / 300 * 100 + 0.5)) >= 100 THEN 'green' WHEN least(100, floor(done / 300 * 100 + 0.5)) >= 60 THEN 'amber' ELSE 'grey' END AS color FROM d")
def daily_goal(spark, sf):
    days = attempts(spark, sf).groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("done"))
    progress = numbers.goal_progress(F.col("done"), F.lit(300))
    return days.select("day", "done", progress.alias("progress"), numbers.goal_color(progress).alias("color"))


@query(
    "history_week_wrong",
    f"""WITH {ATTEMPTS_SQL}, l AS (SELECT * FROM attempts ORDER BY created_at DESC, attempt_id DESC LIMIT 1000)
SELECT attempt_id, question_id, elapsed_ms FROM l WHERE NOT is_correct AND created_at >= TIMESTAMP '{TODAY}' - INTERVAL 7 DAY""",
)
def history_week_wrong(spark, sf):
    return analytics.history(attempts(spark, sf), "week", TODAY, "wrong").select("attempt_id", "question_id", "elapsed_ms")


@query(
    "history_stats",
    f"""WITH {ATTEMPTS_SQL}, l AS (SELECT * FROM attempts ORDER BY created_at DESC, attempt_id DESC LIMIT 1000), c AS (SELECT count(*) AS total, count(*) FILTER (is_correct) AS correct FROM l WHERE created_at >= TIMESTAMP '{TODAY}' - INTERVAL 30 DAY)
SELECT *, {PERCENT_SQL.format(a='correct', b='total')} AS rate FROM c""",
)
def history_stats(spark, sf):
    return analytics.history_stats(analytics.history(attempts(spark, sf), "month", TODAY))


@query("history_page", f"WITH {ATTEMPTS_SQL} SELECT attempt_id, question_id, row_number() OVER (ORDER BY created_at DESC, attempt_id DESC) AS row FROM attempts QUALIFY row BETWEEN 41 AND 60")
def history_page(spark, sf):
    return analytics.page(attempts(spark, sf).select("attempt_id", "question_id", "place"), [F.desc("place")], 3).drop("place")


@query("page_count", f"WITH {ATTEMPTS_SQL} SELECT CAST(ceil(count(*) / 20) AS BIGINT) AS pages FROM attempts")
def page_count(spark, sf):
    return analytics.page_count(attempts(spark, sf))


DAYS_SQL = f"""{ATTEMPTS_SQL}, days AS (SELECT DISTINCT learner_id, CAST(created_at AS DATE) AS day FROM attempts),
islands AS (SELECT learner_id, min(day) AS first_day, max(day) AS last_day, count(*) AS length FROM (SELECT *, day - CAST(row_number() OVER (PARTITION BY learner_id ORDER BY day) AS INTEGER) AS island FROM days) GROUP BY learner_id, island)"""


@query("streak_current", f"WITH {DAYS_SQL} SELECT learner_id, coalesce(max(length) FILTER (last_day >= DATE '{TODAY}' - 1), 0) AS streak FROM islands GROUP BY learner_id")
def streak_current(spark, sf):
    return streaks.current_streak(streaks.active_days(attempts(spark, sf), "created_at", "learner_id"), TODAY, "learner_id")


@query("streak_longest", f"WITH {DAYS_SQL} SELECT learner_id, max(length) AS streak FROM islands GROUP BY learner_id")
def streak_longest(spark, sf):
    return streaks.longest_streak(streaks.active_days(attempts(spark, sf), "created_at", "learner_id"), "learner_id")


@query(
    "streak_from_states",
    f"""{MODEL_SQL}, days AS (SELECT DISTINCT CAST(last_attempt_at AS DATE) AS day FROM stats),
isl AS (SELECT max(day) AS last_day, count(*) AS length FROM (SELECT day, day - CAST(row_number() OVER (ORDER BY day) AS INTEGER) AS island FROM days) GROUP BY island)
SELECT coalesce(max(length) FILTER (last_day >= DATE '{TODAY}' - 1), 0) AS streak FROM isl""",
)
def streak_from_states(spark, sf):
    """The streak of the home page: from the last attempt of each question, so re-answering moves earlier days."""
    return streaks.current_streak(streaks.active_days(state.question_stats(attempts(spark, sf)), "last_attempt_at"), TODAY)


@query("active_days", f"WITH {ATTEMPTS_SQL} SELECT day::DATE AS day, day::DATE IN (SELECT CAST(created_at AS DATE) FROM attempts WHERE learner_id = 1) AS active FROM (SELECT unnest(generate_series(DATE '{TODAY}' - 29, DATE '{TODAY}', INTERVAL 1 DAY)) AS day)")
def active_days(spark, sf):
    return streaks.active_calendar(streaks.active_days(attempts(spark, sf).where("learner_id = 1"), "created_at"), TODAY)


@query("weak_tags", f"{MODEL_SQL}, s AS (SELECT tag, attempt_count AS questions, {PERCENT_SQL.format(a='correct_count', b='attempt_count')} AS rate, wrong_count AS wrong, wrong_count * 3 + (1 - correct_count / attempt_count) * 10 AS priority FROM tag_stats) SELECT *, row_number() OVER (ORDER BY priority DESC, tag) AS rank FROM s QUALIFY rank <= 8")
def weak_tags(spark, sf):
    a, q = attempts(spark, sf), questions(spark, sf)
    return scheduler.weak_tags(state.tag_stats(a, q), q)


@query(
    "review_queue",
    f"""{MODEL_SQL}, r AS (SELECT question_id, review_due_at <= TIMESTAMP '{NOW}' AS due,
  CASE WHEN mastery <= 1 THEN 10 WHEN mastery = 2 THEN 5 ELSE 0 END + CASE WHEN NOT last_correct THEN 8 ELSE 0 END + CASE WHEN wrong_count >= 2 THEN wrong_count * 2 ELSE 0 END + CASE WHEN review_due_at <= TIMESTAMP '{NOW}' THEN 5 ELSE 0 END AS score FROM stats)
SELECT question_id, score, due, row_number() OVER (ORDER BY score DESC, question_id) AS rank FROM r WHERE score > 0""",
)
def review_queue(spark, sf):
    queue = scheduler.review_queue(state.question_stats(attempts(spark, sf)), NOW)
    return ranked(queue, [F.desc("score"), F.asc("question_id")])


@query("due_dates", f"{MODEL_SQL} SELECT question_id, review_due_at, review_due_at <= TIMESTAMP '{NOW}' AS due FROM stats")
def due_dates(spark, sf):
    stats = state.question_stats(attempts(spark, sf))
    return stats.select("question_id", "review_due_at", scheduler.stored_due(F.lit(NOW).cast("timestamp")).alias("due"))


@query(
    "interval_days",
    f"""{MODEL_SQL}, e AS (SELECT question_id, [1, 1, 3, 7, 14, 30][mastery + 1] AS base, correct_count / attempt_count AS rate, CASE WHEN last_correct THEN greatest(1, mastery) ELSE 0 END AS run FROM stats)
SELECT question_id, greatest(1, CAST(floor(base * ((CASE WHEN rate >= 0.9 THEN 1.6::DOUBLE WHEN rate >= 0.7 THEN 1.3::DOUBLE WHEN rate >= 0.5 THEN 1.0::DOUBLE ELSE 0.6::DOUBLE END) * (CASE WHEN run >= 5 THEN 1.2::DOUBLE WHEN run >= 3 THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END)) + 0.5) AS BIGINT)) AS days FROM e""",
)
def interval_days(spark, sf):
    s = state.question_stats(attempts(spark, sf))
    days = schedule.interval_days(F.col("attempt_count"), F.col("correct_count"), F.col("mastery"), F.col("last_correct"))
    return s.select("question_id", days.alias("days"))


@query("wrong_ids", f"{MODEL_SQL} SELECT question_id, wrong_count, row_number() OVER (ORDER BY wrong_count DESC, question_id) AS rank FROM stats WHERE wrong_count > 0 AND (wrong_count >= correct_count OR mastery <= 2)")
def wrong_ids(spark, sf):
    wrong = scheduler.wrong_questions(state.question_stats(attempts(spark, sf))).select("question_id", "wrong_count")
    return ranked(wrong, [F.desc("wrong_count"), F.asc("question_id")])


@query("untouched", f"{MODEL_SQL} SELECT id, group_id FROM questions WHERE id NOT IN (SELECT question_id FROM stats WHERE attempt_count > 0)")
def untouched(spark, sf):
    _, q, s = model(spark, sf)
    return scheduler.untouched(q, s).select("id", "group_id")


@query(
    "merge_stats",
    f"""WITH {ATTEMPTS_SQL}, sides AS (SELECT *, attempt_id % 3 = 0 AS theirs FROM attempts),
r AS (SELECT *, row_number() OVER (PARTITION BY theirs, question_id ORDER BY created_at, attempt_id) AS n, max(CASE WHEN NOT is_correct THEN 1 END) OVER (PARTITION BY theirs, question_id ORDER BY created_at DESC, attempt_id DESC) AS broken FROM sides),
f AS (SELECT theirs, question_id, count(*) AS attempt_count, count(*) FILTER (is_correct) AS correct_count, count(*) FILTER (NOT is_correct AND n > 1) AS wrong_count, least(5, 1 + count(*) FILTER (broken IS NULL)) AS mastery, arg_max(is_correct, n) AS last_correct, max(created_at) AS last_attempt_at FROM r GROUP BY ALL)
SELECT question_id, sum(attempt_count)::BIGINT AS attempt_count, sum(correct_count)::BIGINT AS correct_count, sum(wrong_count)::BIGINT AS wrong_count, max(mastery) AS mastery,
  arg_max(last_correct, (last_attempt_at, NOT theirs)) AS last_correct, max(last_attempt_at) AS last_attempt_at FROM f GROUP BY question_id""",
)
def merge_stats(spark, sf):
    a = attempts(spark, sf)
    theirs = F.col("attempt_id") % 3 == 0
    return state.merge_stats(state.question_stats(a.where(~theirs)), state.question_stats(a.where(theirs))).drop("review_due_at", "bookmarked")


@query("merge_tags", f"{MODEL_SQL} SELECT * FROM tag_stats")
def merge_tags(spark, sf):
    a, q = attempts(spark, sf), questions(spark, sf)
    return state.merge_tags(state.tag_stats(a.where("attempt_id % 3 = 0"), q), state.tag_stats(a.where("attempt_id % 3 <> 0"), q))


@query("reset_group", f"{MODEL_SQL} SELECT question_id, attempt_count FROM stats WHERE question_id NOT IN (SELECT id FROM questions WHERE group_id = 'src3')")
def reset_group(spark, sf):
    _, q, s = model(spark, sf)
    return state.reset_questions(s, q.where("group_id = 'src3'"), "question_id").select("question_id", "attempt_count")


@query("reset_group_tags", f"{MODEL_SQL} SELECT tag, attempt_count FROM tag_stats WHERE tag NOT IN (SELECT unnest(tags) FROM questions WHERE group_id = 'src3')")
def reset_group_tags(spark, sf):
    a, q = attempts(spark, sf), questions(spark, sf)
    gone = q.where("group_id = 'src3'").select(F.explode("tags").alias("id"))
    return state.reset_questions(state.tag_stats(a, q), gone, "tag").select("tag", "attempt_count")


@query("clear_wrong", f"{MODEL_SQL} SELECT question_id, CASE WHEN mastery = 1 THEN 0 ELSE wrong_count END AS wrong_count, CASE WHEN mastery = 1 THEN 3 ELSE mastery END AS mastery FROM stats")
def clear_wrong(spark, sf):
    return state.clear_wrong(state.question_stats(attempts(spark, sf)), F.col("mastery") == 1).select("question_id", "wrong_count", "mastery")


@query("bookmark", f"{MODEL_SQL}, b AS (SELECT id FROM questions WHERE group_id = 'src1') SELECT coalesce(question_id, id) AS question_id, coalesce(attempt_count, 0) AS attempt_count, coalesce(mastery, 0) AS mastery, id IS NOT NULL AS bookmarked FROM stats FULL JOIN b ON question_id = id")
def bookmark(spark, sf):
    _, q, s = model(spark, sf)
    marked = q.where("group_id = 'src1'").select(F.col("id").alias("question_id"))
    return state.bookmark(s, marked).select("question_id", "attempt_count", "mastery", "bookmarked")


@query(
    "session_totals",
    f"""WITH {ATTEMPTS_SQL}, l AS (SELECT learner_id, question_id, arg_max(is_correct, (created_at, attempt_id)) AS ok FROM attempts GROUP BY ALL)
SELECT learner_id AS session_id, count(*) AS answered, count(*) FILTER (ok) AS correct, count(*) FILTER (NOT ok) AS wrong FROM l GROUP BY learner_id""",
)
def session_totals(spark, sf):
    answers = attempts(spark, sf).select(F.col("learner_id").alias("session_id"), F.col("question_id").alias("position"), "question_id", "is_correct", "place")
    return state.session_totals(answers)


@query("settings_merge", "SELECT k AS key, CASE WHEN max(t.v) IS NOT NULL THEN max(t.v) ELSE max(m.v) END AS value FROM (SELECT r_name AS k, 'mine' AS v FROM region) m FULL JOIN (SELECT r_name AS k, 'theirs' AS v FROM region WHERE r_regionkey > 2) t USING (k) GROUP BY k")
def settings_merge(spark, sf):
    region = table(spark, sf, "region")
    mine = region.select(F.col("r_name").alias("key"), F.lit("mine").alias("value"))
    return state.merge_settings(mine, region.where("r_regionkey > 2").select(F.col("r_name").alias("key"), F.lit("theirs").alias("value")))
