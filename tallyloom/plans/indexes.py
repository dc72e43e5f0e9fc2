"""Registered queries: search by posting lists, near-duplicate questions, tables of rules, trees and spans, samples, merged summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import intervals, near_questions, retrieval, rules, sampling, search_index, streaks, summaries
from tallyloom.operators.ordering import ranked
from tallyloom.plans.content import NORM_SQL, search_sql
from tallyloom.plans.learning import DAYS_SQL, TODAY
from tallyloom.sources.shared import materialize
from tallyloom.sources.tables import ATTEMPTS_SQL, QUESTIONS_SQL, attempts, questions, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def indexed_search(words: str):
    """The search through posting lists of five sixths of the bank and of the rest, which was added later."""

    def run(spark, sf):
        bank = questions(spark, sf)
        index = search_index.build(bank.where("id % 6 <> 0")).add(bank.where("id % 6 = 0"))
        return ranked(index.search(bank, words).select("id", "position", "score"), [F.desc("score"), F.asc("position")]).select("id", "score", "rank")

    return run


for name, words in (("search_indexed", "The  src1"), ("search_indexed_rare", "src7 ing lo"), ("search_indexed_short", "e a src")):
    QUERIES[name] = indexed_search(words)
    ORACLE_SQL[name] = search_sql(words.lower().split())


def near_sql(rows: str, percent: int, q: int) -> str:
    """All pairs of classes that share a gram and whose sizes allow the similarity; `rows` is SQL for (id, stem)."""
    return f"""WITH {rows}, n AS (SELECT id, {NORM_SQL.replace("(text,", "(coalesce(stem, ''),")} AS norm FROM rows),
c AS (SELECT norm, min(id) AS class_id FROM n GROUP BY norm),
g AS MATERIALIZED (SELECT class_id, unnest(list_distinct([norm[i:i + {q - 1}] FOR i IN range(1, greatest(length(norm) - {q - 1}, 1) + 1)])) AS g FROM c WHERE norm <> ''),
z AS (SELECT class_id, count(*) AS n FROM g GROUP BY class_id),
s AS MATERIALIZED (SELECT class_id, n, hash(g) AS g FROM g JOIN z USING (class_id)),
p AS (SELECT a.class_id AS a, b.class_id AS b, count(*) AS shared, any_value(a.n + b.n) AS total FROM s a JOIN s b USING (g) WHERE a.class_id < b.class_id AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n) GROUP BY ALL),
l AS (SELECT unnest([a, b]) AS class_id FROM p WHERE 100 * shared >= {percent} * (total - shared)),
k AS (SELECT class_id, count(*) AS links FROM l GROUP BY class_id)
SELECT id, class_id, coalesce(links, 0) AS links FROM n JOIN c USING (norm) LEFT JOIN k USING (class_id)"""


def near_stems(percent: int):
    return lambda spark, sf: near_questions.near_questions(questions(spark, sf), percent, 5)


for percent in (60, 80):
    QUERIES[f"near_questions_{percent}"] = near_stems(percent)
    ORACLE_SQL[f"near_questions_{percent}"] = near_sql(f"{QUESTIONS_SQL}, rows AS (SELECT id, stem FROM questions)", percent, 5)


def near_parts(spark, sf):
    """Short texts by pairs of characters: the descriptions of parts."""
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("stem"))
    return near_questions.near_questions(parts, 80, 2)


QUERIES["near_parts"] = near_parts
ORACLE_SQL["near_parts"] = near_sql("rows AS (SELECT p_partkey AS id, concat_ws(' ', p_name, p_brand, p_type) AS stem FROM part)", 80, 2)


#: Rules made from syllables: rule k looks for three of them, or for others with any vowel between.
SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve au ie qu ur ro el co ai que men des ung sch ein lich".split()
N_RULES = 2000


def made_rules(n: int = N_RULES) -> list[tuple[str, str]]:
    s, m = SYLLABLES, len(SYLLABLES)
    return [(f"t{k % 500}", f"(?i){s[k // m % m]}{s[k % m]}{s[(7 * k + 3) % m]}|{s[k % m]}{s[k // m % m]}[aeiou]{s[(5 * k + 1) % m]}") for k in range(n)]


def many_rules(spark, sf):
    tagged = rules.tag_texts(table(spark, sf, "documents"), made_rules(), "doc_id")
    return tagged.select(F.col("id").alias("doc_id"), F.array_join("tags", ",").alias("tags"))


QUERIES["auto_tags_many"] = many_rules
_LIST = "[" + ", ".join(f"'{x}'" for x in SYLLABLES) + "]"
_AT = lambda e: f"s[({e}) % {len(SYLLABLES)} + 1]"
ORACLE_SQL["auto_tags_many"] = f"""WITH s AS (SELECT {_LIST} AS s), r AS (
  SELECT k, 't' || k % 500 AS name, {_AT(f"k // {len(SYLLABLES)}")} || {_AT("k")} || {_AT("7 * k + 3")} AS word, {_AT("k")} || {_AT(f"k // {len(SYLLABLES)}")} AS start, {_AT("5 * k + 1")} AS rest FROM s, range({N_RULES}) AS n(k)
), d AS MATERIALIZED (SELECT doc_id, lower(text) AS l FROM documents),
h AS (SELECT doc_id, name, min(k) AS k FROM d, r WHERE contains(l, word) OR contains(l, start) AND regexp_matches(l, start || '[aeiou]' || rest) GROUP BY ALL)
SELECT doc_id, coalesce(string_agg(name, ',' ORDER BY k), '') AS tags FROM documents LEFT JOIN h USING (doc_id) GROUP BY doc_id"""


def places(spark, sf):
    """A tree (key, parent): customers in nations in regions."""
    node = lambda t, key, parent: table(spark, sf, t).select(F.expr(key).alias("key"), F.expr(parent).alias("parent"))
    tops = node("region", "'r' || r_regionkey", "CAST(NULL AS STRING)")
    return tops.unionByName(node("nation", "'n' || n_nationkey", "'r' || n_regionkey")).unionByName(node("customer", "'c' || c_custkey", "'n' || c_nationkey"))


PLACES_SQL = """t(key, parent) AS (SELECT 'r' || r_regionkey, NULL FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer)"""


def course_tree(spark, sf):
    return retrieval.ancestors(places(spark, sf))


def tree_labels(spark, sf):
    return intervals.tree_labels(places(spark, sf))


def subtree_members(spark, sf):
    """All that is below a region, by one range of labels."""
    labels = intervals.materialize(intervals.tree_labels(places(spark, sf)), "labels")
    return intervals.subtree(labels, "r1").select("key", "depth")


QUERIES |= {"course_tree": course_tree, "tree_labels": tree_labels, "subtree_members": subtree_members}
_PATHS = f"WITH RECURSIVE {PLACES_SQL}, p AS (SELECT key, parent, [key] AS path FROM t WHERE parent IS NULL UNION ALL SELECT t.key, t.parent, list_append(p.path, t.key) FROM t JOIN p ON t.parent = p.key)"
ORACLE_SQL |= {
    "course_tree": f"WITH RECURSIVE {PLACES_SQL}, a AS (SELECT key, parent AS ancestor, 1 AS up FROM t WHERE parent IS NOT NULL UNION ALL SELECT a.key, t.parent, up + 1 FROM a JOIN t ON a.ancestor = t.key WHERE t.parent IS NOT NULL) SELECT * FROM a",
    "tree_labels": f"""{_PATHS}, n AS (SELECT *, row_number() OVER (ORDER BY path) AS entry FROM p), u AS (SELECT top, count(*) AS members FROM (SELECT unnest(path) AS top FROM n) GROUP BY top)
SELECT key, parent, len(path) - 1 AS depth, entry, entry + members - 1 AS exit FROM n JOIN u ON top = key""",
    "subtree_members": f"{_PATHS} SELECT key, len(path) - 1 AS depth FROM p WHERE list_contains(path, 'r1') AND key <> 'r1'",
}

HOUR = 3_600_000_000


def presence(spark, sf):
    """For each attempt, the attempts of other learners while its learner stays: an hour from the attempt on; attempts without any are left out."""
    log = attempts(spark, sf).select("attempt_id", "learner_id", F.unix_micros("created_at").alias("at")).where("learner_id IS NOT NULL AND at IS NOT NULL")
    everyone = intervals.within(log, "at", HOUR).select("at", F.col("inside").alias("everyone"))
    own = intervals.within(log, "at", HOUR, ("learner_id",)).select("learner_id", "at", F.col("inside").alias("own"))
    met = log.join(everyone, "at").join(own, ["learner_id", "at"]).where("everyone > own")
    return met.groupBy("attempt_id").agg(F.sum(F.col("everyone") - F.col("own")).alias("others"))


QUERIES["presence"] = presence
ORACLE_SQL["presence"] = f"WITH {ATTEMPTS_SQL} SELECT s.attempt_id, count(*) AS others FROM attempts s JOIN attempts o ON o.created_at >= s.created_at AND o.created_at <= s.created_at + INTERVAL 1 HOUR AND o.learner_id <> s.learner_id GROUP BY s.attempt_id"


def streaks_merged(spark, sf):
    """Current and longest streak of every learner from summaries of weeks."""
    days = streaks.active_days(attempts(spark, sf), "created_at", "learner_id")
    return streaks.merged_streaks(streaks.block_summaries(days.where(F.col("day") <= TODAY), "learner_id", block_days=7), TODAY, "learner_id")


QUERIES["streaks_merged"] = streaks_merged
ORACLE_SQL["streaks_merged"] = f"WITH {DAYS_SQL} SELECT learner_id, coalesce(max(length) FILTER (last_day >= DATE '{TODAY}' - 1), 0) AS streak, max(length) AS longest FROM islands GROUP BY learner_id"

#: Questions that an exam takes of each group.
QUOTAS = {"src1": 3, "src2": 5, "src5": 1, "src19": 7, "none": 4, "src3": 0}


def exam_quotas(spark, sf):
    return sampling.by_quotas(questions(spark, sf), QUOTAS, "group_id", seed="exam").select("id", "group_id", "draw")


def samples_merged(spark, sf):
    """Four questions of each group and type, drawn from three parts of the bank and merged."""
    bank = questions(spark, sf).select("id", "group_id", "status")
    drawn = [sampling.bottom_k(bank.where(f"id % 3 = {r}"), 4, ["group_id", "status"], seed="s") for r in range(3)]
    return sampling.merged(drawn, 4, ["group_id", "status"], seed="s")


QUERIES |= {"exam_quotas": exam_quotas, "samples_merged": samples_merged}
ORACLE_SQL |= {
    "exam_quotas": f"WITH {QUESTIONS_SQL}, k(group_id, k) AS (VALUES {', '.join(f"('{g}', {n})" for g, n in QUOTAS.items())}) SELECT id, group_id, row_number() OVER w AS draw FROM questions JOIN k USING (group_id) WINDOW w AS (PARTITION BY group_id ORDER BY md5('exam:' || id), id) QUALIFY draw <= k",
    "samples_merged": f"WITH {QUESTIONS_SQL} SELECT id, group_id, status, row_number() OVER w AS draw FROM questions WINDOW w AS (PARTITION BY group_id, status ORDER BY md5('s:' || id), id) QUALIFY draw <= 4",
}

#: Days before the last one that a window of the report takes in.
WINDOWS = {"day": 1, "week": 7, "month": 30}


def answer_times(spark, sf):
    """Answer time (median and 95th of a hundred) and active learners by group, by category and over all, for three windows, from daily summaries stored once."""
    bank = questions(spark, sf).select("id", "group_id", "category")
    log = attempts(spark, sf).select("question_id", "learner_id", "elapsed_ms", F.to_date("created_at").alias("day"))
    rows = log.join(bank, F.col("question_id") == F.col("id"))
    stored = materialize(summaries.summarize(rows, ["group_id", "category", "day"], "elapsed_ms", "learner_id"), "daily")
    windows = {name: F.col("day").between(F.date_sub(F.lit(TODAY).cast("date"), n - 1), F.lit(TODAY).cast("date")) for name, n in WINDOWS.items()}
    made = summaries.report(stored, [["group_id"], ["category"], []], windows, [50, 95])
    return made.select("window", "group_id", "category", "n", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"), "members")


QUERIES["answer_times"] = answer_times
_REST = summaries.BITS - summaries.REGISTER_BITS
_CELL = f"CASE WHEN {{x}} <= 0 THEN 0.0 ELSE 2 * pow({summaries.BASE!r}, ceil(ln({{x}}::DOUBLE) / ln({summaries.BASE!r}))) / ({summaries.BASE!r} + 1) END"
ORACLE_SQL["answer_times"] = f"""WITH {ATTEMPTS_SQL}, {QUESTIONS_SQL}, b AS (SELECT group_id, category, CAST(created_at AS DATE) AS day, elapsed_ms, learner_id, ('0x' || substr(md5(learner_id::VARCHAR), 1, {summaries.BITS // 4}))::BIGINT AS h FROM attempts JOIN questions ON question_id = id),
w(name, days) AS (VALUES {", ".join(f"('{k}', {n})" for k, n in WINDOWS.items())}),
x AS (SELECT name AS win, b.* FROM b JOIN w ON day > DATE '{TODAY}' - days AND day <= DATE '{TODAY}'),
l AS (SELECT win, group_id, NULL AS category, elapsed_ms, h FROM x UNION ALL SELECT win, NULL, category, elapsed_ms, h FROM x UNION ALL SELECT win, NULL, NULL, elapsed_ms, h FROM x),
s AS (SELECT win, group_id, category, list_sort(list(elapsed_ms)) AS v FROM l GROUP BY ALL),
r AS (SELECT win, group_id, category, h >> {_REST} AS cell, max(CASE WHEN (h & {(1 << _REST) - 1}) = 0 THEN {_REST + 1} ELSE {_REST} - floor(log2((h & {(1 << _REST) - 1})::DOUBLE)) END) AS rho FROM l GROUP BY ALL),
d AS (SELECT win, group_id, category, sum(pow(2.0, -rho)) AS s, {summaries.REGISTERS} - count(*) AS empty FROM r GROUP BY ALL),
e AS (SELECT *, {0.7213 / (1 + 1.079 / summaries.REGISTERS) * summaries.REGISTERS**2!r} / (s + empty) AS raw FROM d)
SELECT s.win AS "window", s.group_id, s.category, len(v) AS n, round({_CELL.format(x="v[(50 * (len(v) - 1)) // 100 + 1]")}, 6) AS p50, round({_CELL.format(x="v[(95 * (len(v) - 1)) // 100 + 1]")}, 6) AS p95,
  floor(CASE WHEN raw <= {2.5 * summaries.REGISTERS} AND empty > 0 THEN {summaries.REGISTERS} * ln({float(summaries.REGISTERS)} / empty) ELSE raw END + 0.5)::BIGINT AS members
FROM s JOIN e ON s.win = e.win AND s.group_id IS NOT DISTINCT FROM e.group_id AND s.category IS NOT DISTINCT FROM e.category"""
