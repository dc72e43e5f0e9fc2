"""Search, pools, lookups and the course tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.functions.numbers import percent
from tallyloom.functions.text import strip_markdown, truncate
from tallyloom.operators.ordering import ranked
from tallyloom.sources.shared import materialize

#: Points for a keyword in each field.
STEM, STEM_START, HEADWORD, TAG, POINT, TRANSLATION, EXPLANATION = 10, 5, 8, 6, 6, 4, 2


def keywords(query: str) -> list[str]:
    return query.lower().split()


def keyword_score(columns: set[str], word: str) -> Column:
    """Points of one keyword over the fields a bank has."""
    has = lambda c: F.coalesce(F.contains(F.lower(F.col(c)), F.lit(word)), F.lit(False))
    any_of = lambda c: F.coalesce(F.exists(c, lambda t: F.contains(F.lower(t), F.lit(word))), F.lit(False))
    points = [
        F.when(has("stem"), F.when(F.startswith(F.lower("stem"), F.lit(word)), STEM + STEM_START).otherwise(STEM)).otherwise(0),
        *[F.when(has(c), p).otherwise(0) for c, p in (("headword", HEADWORD), ("translation", TRANSLATION), ("explanation", EXPLANATION)) if c in columns],
        *[F.when(any_of(c), p).otherwise(0) for c, p in (("tags", TAG), ("grammar_points", POINT)) if c in columns],
    ]
    return sum(points[1:], points[0])


def search(questions: DataFrame, query: str, limit: int | None = 50) -> DataFrame:
    """(questions, score): rows that contain every keyword, best first and equal ones in bank order; no keyword, no rows."""
    found = keywords(query)
    if not found:
        return questions.withColumn("score", F.lit(0)).limit(0)
    scores = [keyword_score(set(questions.columns), w) for w in found]
    rows = questions
    for score in scores:
        rows = rows.where(score > 0)
    rows = rows.withColumn("score", sum(scores[1:], scores[0]))
    return rows.orderBy(F.desc("score"), "position").limit(limit) if limit else rows


def has_tag(tag: str) -> Column:
    return F.array_contains("tags", tag) | F.array_contains("grammar_points", tag)


def visible(questions: DataFrame, hidden_groups: DataFrame, unlocked: bool) -> DataFrame:
    """Questions outside the hidden groups (column `group_id`), or all when unlocked."""
    return questions if unlocked else questions.join(hidden_groups.select("group_id").distinct(), "group_id", "left_anti")


def hidden_groups(sub_banks: DataFrame) -> DataFrame:
    """Groups of the sub-banks (groups array, requires_unlock) that need unlocking."""
    return sub_banks.where("requires_unlock").select(F.explode("groups").alias("group_id")).distinct()


def seeded_order(key: Column, seed: str) -> Column:
    """An order that looks random and follows from the seed alone."""
    return F.md5(F.concat_ws("/", F.lit(seed), key.cast("string")))


def pool(
    questions: DataFrame,
    stats: DataFrame,
    *,
    tag: str | None = None,
    groups: list[str] | None = None,
    ids: list | None = None,
    question_type: str | None = None,
    mode: str = "sequential",
    shuffle: bool = False,
    seed: str = "0",
) -> DataFrame:
    """(questions, pool_order): the questions of a quiz in order; the least `pool_order` comes first.

    A tag overrules every other filter and the shuffling. A list of ids turns every mode but `untouched` into
    `wrong`, which is in bank order unless shuffled. `weakness` and `exam` ignore the filters and take the
    whole bank: weak questions (mastery 2 or less) first, or all in seeded order.
    """
    if ids and mode != "untouched":
        mode = "wrong"
    in_bank_order = F.lpad(F.col("position").cast("string"), 20, "0")
    mixed = seeded_order(F.col("id"), seed)
    if tag is not None:
        return questions.where(has_tag(tag)).withColumn("pool_order", in_bank_order)
    if mode == "exam":
        return questions.withColumn("pool_order", mixed)
    if mode == "weakness":
        weak = stats.where("mastery <= 2").select(F.col("question_id").alias("_weak"))
        joined = questions.join(weak, F.col("id") == F.col("_weak"), "left")
        return joined.withColumn("pool_order", F.when(F.col("_weak").isNotNull(), F.concat(F.lit("0"), in_bank_order)).otherwise(F.concat(F.lit("1"), mixed))).drop("_weak")
    rows = questions
    if groups:
        rows = rows.where(F.col("group_id").isin(*groups))
    if ids:
        rows = rows.where(F.col("id").isin(*ids))
    if question_type:
        rows = rows.where(F.col("question_type") == question_type)
    random = mode == "random" or (shuffle and mode in ("wrong", "untouched"))
    return rows.withColumn("pool_order", mixed if random else in_bank_order)


def in_list_order(ids: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows for a list (position, key), in its order; entries without a row drop out."""
    return ids.join(rows, key).orderBy("position") if "position" not in rows.columns else ids.join(rows.drop("position"), key).orderBy("position")


def configured_order(groups: DataFrame, order: DataFrame) -> DataFrame:
    """Groups (group_id, first) in the configured order (group_id, place), unknown entries dropped, the others after in bank order."""
    return ranked(groups.join(order, "group_id", "left"), [F.col("place").asc_nulls_last(), F.asc("first")])


def first_answers(answers: DataFrame, *keys: str) -> DataFrame:
    """The first answer of each key."""
    return answers.groupBy(*keys).agg(F.min_by("is_correct", "place").alias("is_correct"), F.min("place").alias("place"))


def ancestors(nodes: DataFrame) -> DataFrame:
    """(key, ancestor, up) of a tree table (key, parent), by one join for each level until none is left.

    A level beyond the number of nodes means that the parents run in a circle, which is an error.
    """
    step = nodes.select(F.col("key").alias("low"), F.col("parent").alias("high")).where("high IS NOT NULL")
    level = materialize(step.select(F.col("low").alias("key"), F.col("high").alias("ancestor"), F.lit(1).alias("up")), "ancestors")
    found, up, most = level, 1, step.count()
    while not level.isEmpty():
        if up > most:
            raise ValueError("the parents of the tree run in a circle")
        up += 1
        level = materialize(level.join(step, level["ancestor"] == step["low"]).select("key", F.col("high").alias("ancestor"), F.lit(up).alias("up")), "ancestors")
        found = found.unionByName(level)
    return found


def ancestors_of_path(path: Column) -> Column:
    """Every proper prefix of a path array, outermost first, joined by slashes."""
    return F.when(F.size(path) > 1, F.transform(F.sequence(F.lit(1), F.size(path) - 1), lambda n: F.array_join(F.slice(path, F.lit(1), n), "/"))).otherwise(F.array().cast("array<string>"))


def shown_stem(stem: Column, limit: int) -> Column:
    """Plain text of a stem, cut for a list."""
    return truncate(strip_markdown(F.coalesce(stem, F.lit(""))), limit)


def with_questions(rows: DataFrame, questions: DataFrame) -> DataFrame:
    """`rows`(question_id, ...) with `stem` and `group` of the question; both empty where the bank lacks it."""
    shown = questions.select(F.col("id").alias("_id"), F.col("stem").alias("_stem"), F.col("group_title").alias("_group"))
    joined = rows.join(shown, F.col("question_id") == F.col("_id"), "left")
    return joined.select(*rows.columns, F.coalesce("_stem", F.lit("")).alias("stem"), F.coalesce("_group", F.lit("")).alias("group"))


def item_info(rows: DataFrame, questions: DataFrame, limit: int = 40) -> DataFrame:
    """`rows`(question_id, ...) with the cut `stem`, or the id of a question that the bank lacks, and its `group`."""
    known = questions.select(F.col("id").alias("_id"), shown_stem(F.col("stem"), limit).alias("_stem"), F.col("group_title").alias("_group"))
    joined = rows.join(known, F.col("question_id") == F.col("_id"), "left")
    return joined.select(*rows.columns, F.coalesce("_stem", F.col("question_id").cast("string")).alias("stem"), F.coalesce("_group", F.lit("")).alias("group"))


#: Orders of the lists of states: in stored order, by wrong answers, by time.
LIST_ORDERS = {"all": [], "most-wrong": ["wrong_count"], "recent": ["last_attempt_at"]}


def listed(states: DataFrame, order: str) -> DataFrame:
    """`states` with their `rank` in a list; equal rows in stored order, that of question_id."""
    return ranked(states, [*[F.desc(c) for c in LIST_ORDERS[order]], F.asc("question_id")])


def bookmarked(states: DataFrame, mastered_only: bool = False) -> DataFrame:
    rows = states.where("bookmarked")
    return rows.where("mastery >= 4") if mastered_only else rows


def top_wrong(states: DataFrame, questions: DataFrame, n: int = 10) -> DataFrame:
    """(rank, question_id, stem, wrong_count, rate) of the `n` states with most wrong answers; the list is the feature."""
    order = [F.desc("wrong_count"), F.asc("question_id")]
    worst = ranked(states.where("wrong_count > 0"), order, n).select("rank", "question_id", "wrong_count", percent(F.col("correct_count"), F.col("attempt_count")).alias("rate"))
    shown = with_questions(worst, questions)
    return shown.select("rank", "question_id", shown_stem(F.col("stem"), 50).alias("stem"), "wrong_count", "rate")


def session_results(session: DataFrame, answers: DataFrame, questions: DataFrame) -> DataFrame:
    """(session_id, position, question_id, stem, selected) of the wrong questions of a session, in its order.

    `selected` is the first answer to that question in the session. `session`: session_id, position, question_id, is_wrong;
    `answers`: session_id, question_id, selected, place.
    """
    first = answers.groupBy("session_id", "question_id").agg(F.min_by("selected", "place").alias("selected"))
    rows = session.where("is_wrong").select("session_id", "position", "question_id").join(first, ["session_id", "question_id"], "left")
    shown = questions.select(F.col("id").alias("question_id"), shown_stem(F.col("stem"), 80).alias("stem"))
    return rows.join(shown, "question_id").select("session_id", "position", "question_id", "stem", F.coalesce("selected", F.lit("")).alias("selected"))


def page_of(index: Column, total: Column, size: int = 100) -> Column:
    """struct(page, start, end): the page, from 0, that shows an index, and its range."""
    page = F.floor(index / size).cast("bigint")
    return F.struct(page.alias("page"), (page * size).alias("start"), F.least(page * size + size, total).alias("end"))


def in_locale_order(groups: DataFrame, key: str = "group_id") -> DataFrame:
    """Groups with their `rank` by the root locale: letters before case."""
    return ranked(groups, [F.asc(F.collate(key, "UNICODE"))])


def sub_bank_counts(questions: DataFrame, sub_banks: DataFrame) -> DataFrame:
    """(name, groups, questions): groups and questions of each sub-bank (name, groups array)."""
    listed_groups = sub_banks.select("name", F.size("groups").cast("bigint").alias("n_groups"), F.explode("groups").alias("group_id")).distinct()
    counts = questions.groupBy("group_id").agg(F.count("*").alias("n"))
    return listed_groups.join(counts, "group_id", "left").groupBy("name", F.col("n_groups").alias("groups")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("questions"))


def sub_bank_ids(questions: DataFrame, chosen: DataFrame, groups: list[str], order: list[Column]) -> DataFrame:
    """(id, group_id, rank): questions with an id in `chosen`(id, ...) over a sub-bank's groups, group by group in its order.

    Within a group they follow `order`, columns of `questions` or `chosen`.
    """
    place = F.array_position(F.array(*[F.lit(g) for g in groups]), F.col("group_id"))
    rows = questions.where(F.col("group_id").isin(*groups)).select("id", "group_id", "position").join(chosen, "id")
    return ranked(rows, [place.asc(), *order]).select("id", "group_id", "rank")


def session_progress(index: Column, submitted: Column, total: Column, correct: Column, answered: Column) -> Column:
    """struct(current, total, correct, answered) of a running session."""
    return F.struct((index + submitted.cast("int")).cast("bigint").alias("current"), total.alias("total"), correct.alias("correct"), answered.alias("answered"))


def chat_request(messages: DataFrame, system: Column, asked: Column, n: int = 10) -> DataFrame:
    """(conv_id, messages): the system message, the last `n` messages of the conversation, and the current question."""
    said = lambda role, content: F.struct(role.alias("role"), content.alias("content"))
    recent = last_messages(messages, n).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("rows"))
    history = F.transform("rows", lambda m: said(m["role"], m["text"]))
    return recent.select("conv_id", F.concat(F.array(said(F.lit("system"), system)), history, F.array(said(F.lit("user"), asked))).alias("messages"))


def last_messages(messages: DataFrame, n: int = 10) -> DataFrame:
    """The last `n` messages of each conversation."""
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return messages.withColumn("_back", F.row_number().over(newest)).where(F.col("_back") <= n).drop("_back")


def session_in_progress(age_hours: Column, total: Column, index: Column, submitted: Column) -> Column:
    """A session can go on: not empty, at most a day old, and with a question left."""
    return (total > 0) & (age_hours <= 24) & (index + submitted.cast("int") < total)


def relative_day(at: Column, now: Column) -> Column:
    """today, yesterday, `n days ago` within a week, else month-day; by whole 24 h."""
    days = F.floor((F.unix_timestamp(now) - F.unix_timestamp(at)) / 86_400)
    return F.when(days <= 0, "today").when(days == 1, "yesterday").when(days < 7, F.concat(days.cast("string"), F.lit(" days ago"))).otherwise(F.concat(F.month(at).cast("string"), F.lit("-"), F.dayofmonth(at).cast("string")))
