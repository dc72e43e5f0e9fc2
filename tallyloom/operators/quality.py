"""Duplicates and data quality of a question bank (id, position, group_id, category, stem, tags, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.functions.text import norm_audit, norm_parser
from tallyloom.operators.ordering import ranked
from tallyloom.sources.shared import materialize


def keyed(questions: DataFrame, key: Column | None = None) -> DataFrame:
    """Questions with `key`, the 128-bit digest of the normalized stem (texts may be long, digests are not)."""
    return questions.withColumn("key", F.md5(norm_audit(F.col("stem")) if key is None else key))


def clusters(questions: DataFrame, *within: str) -> DataFrame:
    """(within, key, copies, groups) of every key that occurs twice or more."""
    return keyed(questions).groupBy(*within, "key").agg(F.count("*").alias("copies"), F.countDistinct("group_id").alias("groups")).where("copies > 1")


def duplicate_summary(questions: DataFrame) -> DataFrame:
    counts = keyed(questions).groupBy("key").agg(F.count("*").alias("n"), F.countDistinct("group_id").alias("groups"))
    percent = F.round(F.try_divide(F.sum("n") - F.count("*"), F.sum("n")) * 100, 1)
    return counts.agg(F.sum("n").alias("rows"), F.count("*").alias("unique_keys"), F.count_if(F.col("n") > 1).alias("clusters"), (F.sum("n") - F.count("*")).alias("extra_copies"), F.count_if((F.col("n") > 1) & (F.col("groups") > 1)).alias("across_groups"), percent.alias("extra_percent"))


#: Groups of a key that one task pairs with all others.
SPLIT = 4096


def group_pairs(questions: DataFrame, n: int = 15) -> DataFrame:
    """The `n` pairs of groups that share most stems. Each key lists its groups once, so pairs grow with groups, not rows.

    Keys with the same set of groups fold into one with a weight, so copied sets of stems pair their groups once; the
    groups of a key that many have are paired in parts of about `SPLIT`. Sets are told apart by two sums of hashes.
    """
    places = keyed(questions).where("group_id IS NOT NULL").select("key", "group_id").distinct()
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), "group_id").cast("decimal(20,0)"))
    sets = places.groupBy("key").agg(F.count("*").alias("size"), total(1).alias("one"), total(2).alias("two")).where("size > 1")
    classes = sets.groupBy("size", "one", "two").agg(F.min("key").alias("key"), F.count("*").alias("weight"))
    rows = places.join(classes.select("key", "weight", F.ceil(F.col("size") / SPLIT).cast("int").alias("parts")), "key")
    left = rows.select("key", F.col("group_id").alias("first"), F.pmod(F.xxhash64("group_id"), F.col("parts")).cast("int").alias("part"), "weight")
    right = rows.select("key", F.col("group_id").alias("second"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    pairs = left.join(right, ["key", "part"]).where("first < second").groupBy("first", "second").agg(F.sum("weight").alias("shared"))
    return pairs.orderBy(F.desc("shared"), "first", "second").limit(n)


def keys_per_group(questions: DataFrame) -> DataFrame:
    by_key = keyed(questions).groupBy("group_id", "key").agg(F.count("*").alias("n"))
    return by_key.groupBy("group_id").agg(F.sum("n").alias("total"), F.count("*").alias("unique_keys"), (F.sum("n") - F.count("*")).alias("duplicates"))


def _best(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; Spark limits each task's groups before the shuffle, so hot keys stay small."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def ranked_dedup(questions: DataFrame, order: list[Column], *domain: str, key: Column | None = None) -> DataFrame:
    """One survivor of each (domain, key): the first in `order`, then in bank order; other domains keep their own copies."""
    return _best(keyed(questions, key), [*domain, "key"], [*order, F.asc("position")]).drop("key")


def agreeing_dedup(questions: DataFrame, answer: Column, weight: Column, *within: str, columns: list[str] | None = None) -> DataFrame:
    """Clusters whose answers all agree keep the heaviest row (first of equals); clusters in conflict stay whole.

    Of the questions' columns `columns` are given, or all. Keys are made once and stored with these, so that texts are read once.
    """
    wanted = columns or questions.columns
    rows = keyed(questions).withColumn("_answer", F.md5(norm_audit(answer))).withColumn("_weight", weight)
    rows = materialize(rows.select(*dict.fromkeys([*wanted, "position", *within]), "key", "_answer", "_weight"), "keyed")
    answers = rows.groupBy(*within, "key").agg((F.min("_answer") == F.max("_answer")).alias("_agree"))
    joined = rows.join(answers, [*within, "key"])
    best = _best(joined.where("_agree"), [*within, "key"], [F.desc("_weight"), F.asc("position")])
    return best.unionByName(joined.where("NOT _agree")).select(*wanted)


def majority_answer(questions: DataFrame, answer: Column) -> DataFrame:
    """(key, answer, votes) of every key: the most frequent answer, the first seen of equals."""
    votes = keyed(questions).withColumn("answer", answer).groupBy("key", "answer").agg(F.count("*").alias("votes"), F.min("position").alias("first"))
    return _best(votes, ["key"], [F.desc("votes"), F.asc("first")]).drop("first")


def answer_agreement(questions: DataFrame, answer: Column) -> DataFrame:
    """(key, copies, agree) of every cluster."""
    rows = keyed(questions).withColumn("_answer", norm_audit(answer))
    return rows.groupBy("key").agg(F.count("*").alias("copies"), (F.min("_answer") == F.max("_answer")).alias("agree")).where("copies > 1")


def duplicate_report(questions: DataFrame) -> DataFrame:
    """(key, copies, position, id, group_id): every member of each cluster as a row, so that a cluster may have any size."""
    rows = keyed(questions).select("key", "position", "id", "group_id")
    sizes = rows.groupBy("key").agg(F.count("*").alias("copies")).where("copies > 1")
    return rows.join(sizes, "key").select("key", "copies", "position", "id", "group_id")


def audit(questions: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, failures): rows that break each rule, counted in one pass."""
    counts = questions.agg(*[F.count_if(F.coalesce(bad, F.lit(False))).alias(name) for name, bad in rules.items()])
    pairs = ", ".join(f"'{name}', `{name}`" for name in rules)
    return counts.selectExpr(f"stack({len(rules)}, {pairs}) AS (rule, failures)")


def rejects(questions: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that break a rule, with the names of the rules as `reasons`."""
    reasons = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]))
    return questions.withColumn("reasons", reasons).where(F.size("reasons") > 0)


def repeated_ids(questions: DataFrame, key: str = "id") -> DataFrame:
    return questions.groupBy(key).agg(F.count("*").alias("copies")).where("copies > 1")


def require_clean(report: DataFrame) -> None:
    """Fails when a rule of `report`(rule, failures) has failures; the report has one row for each rule."""
    broken = [f"{r.rule}: {r.failures}" for r in report.where("failures > 0").orderBy("rule").collect()]
    if broken:
        raise ValueError("rules broken: " + ", ".join(broken))


def repeated_options(options: Column) -> Column:
    texts = F.transform(options, lambda o: o["text"])
    return F.size(F.array_distinct(texts)) < F.size(texts)


def few_options(question_type: Column, options: Column) -> Column:
    """A multiple choice with fewer than three options cannot be answered wrongly."""
    return (question_type == "multi") & (F.size(options) < 3)


def number_lists(questions: DataFrame, number: str) -> DataFrame:
    """(group_id, number, place): the numbers of each group in order, as rows, so that a group may have any size."""
    rows = ranked(questions.select("group_id", F.col(number).alias("number")), [F.asc("group_id"), F.asc("number")], name="_rank")
    firsts = rows.groupBy("group_id").agg(F.min("_rank").alias("_first"))
    return rows.join(firsts, "group_id").select("group_id", "number", (F.col("_rank") - F.col("_first") + 1).alias("place"))


def later_repeats(options: Column) -> Column:
    """Places, from 0, of the options whose text an earlier option has."""
    texts = F.transform(options, lambda o: o["text"])
    return F.filter(F.transform(texts, lambda t, i: F.when(F.array_position(texts, t) - 1 < i, i)), lambda i: i.isNotNull())


def renumber(questions: DataFrame, *section: str) -> DataFrame:
    """Numbers from 1 in bank order within each section."""
    return questions.withColumn("number", F.row_number().over(Window.partitionBy(*section).orderBy("position")).cast("bigint"))


def domain_dedup(questions: DataFrame, domains: list[list[str]], last: list | None = None) -> DataFrame:
    """One survivor of each stem and type within a domain of groups; equal stems of different domains all stay.

    The row with most options stays, of these that of the first group of its domain, of these the one with the
    longest explanation; rows whose id is in `last` give way to any other. Groups outside the domains go, and
    so do multiple choices with fewer than three options. Columns: group_id, stem, question_type, options,
    explanation, id, position.
    """
    place = F.create_map(*[x for d, groups in enumerate(domains) for p, g in enumerate(groups) for x in (F.lit(g), F.struct(F.lit(d).alias("domain"), F.lit(p).alias("place")))])
    rows = questions.withColumn("_at", F.try_element_at(place, F.col("group_id"))).where("_at IS NOT NULL").withColumn("_domain", F.col("_at.domain"))
    key = F.concat_ws("|", norm_parser(F.col("stem")), F.col("question_type"))
    order = [F.asc(F.col("id").isin(last or [])), F.desc(F.size("options")), F.asc("_at.place"), F.desc(F.length(F.coalesce("explanation", F.lit(""))))]
    kept = ranked_dedup(rows, order, "_domain", key=key)
    return kept.where(~few_options(F.col("question_type"), F.col("options"))).drop("_at", "_domain")


def resolve_conflicts(questions: DataFrame, answer: Column) -> DataFrame:
    """Clusters whose answers differ keep one row: the first with the majority's answer, with `note` naming the others.

    Equal counts go to the answer seen first; the other rows have a null note.
    """
    rows = keyed(questions).withColumn("_answer", answer)
    votes = rows.groupBy("key", "_answer").agg(F.count("*").alias("votes"), F.min("position").alias("first"), F.min_by("id", "position").alias("_id"))
    clusters_ = votes.groupBy("key").agg(F.count("*").alias("answers"), F.max(F.struct("votes", (-F.col("first")).alias("early"), "_answer", "_id")).alias("win"))
    # an answer is named if a row other than the winner gave it; the winner's own answer comes where its next copy does
    conflicts = clusters_.where("answers > 1").select("key", F.col("win._id").alias("_winner"), F.col("win._answer").alias("_won"))
    second = rows.join(conflicts, "key").where(F.col("id") != F.col("_winner")).groupBy("key", "_winner", "_answer").agg(F.min("position").alias("first"))
    named = second.groupBy("key", "_winner").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "_answer"))), lambda x: x["_answer"]), " / ").alias("_others"))
    joined = rows.join(named, "key", "left").where(F.col("_winner").isNull() | (F.col("id") == F.col("_winner")))
    note = F.concat(F.lit("【存疑·原题库存在答案分歧："), F.col("_others"), F.lit("】 "))
    return joined.select(*questions.columns, note.alias("note"))


def without_sub_headers(questions: DataFrame) -> DataFrame:
    """Questions whose stem is not the sub-header of a section."""
    #: Numbers and kinds of sub-headers.
    return questions.where(~F.coalesce(F.col("stem").rlike("^[一二三四五六]、(单项选择|单选|多项选择|多选|判断正误|判断|填空)题"), F.lit(False)))


def file_report(questions: DataFrame, files: dict[str, list[str]]) -> DataFrame:
    """(file, total, unique_keys, clusters, extra, across, across_extra, within, within_extra) of each file of groups.

    A cluster is `across` if its copies are in several groups of the file, else `within`. Blank stems have no key.
    """
    file_of = F.create_map(*[x for f, groups in files.items() for g in groups for x in (F.lit(g), F.lit(f))])
    rows = keyed(questions).withColumn("file", F.try_element_at(file_of, F.col("group_id"))).where("file IS NOT NULL")
    blank = F.md5(F.lit(""))
    per_key = rows.groupBy("file", "key").agg(F.count("*").alias("n"), F.countDistinct("group_id").alias("groups"))
    real, several = F.col("key") != blank, (F.col("n") > 1) & (F.col("key") != blank)
    extra = lambda c: F.coalesce(F.sum(F.when(c, F.col("n") - 1)), F.lit(0))
    across, within = several & (F.col("groups") > 1), several & (F.col("groups") == 1)
    return per_key.groupBy("file").agg(F.sum("n").alias("total"), F.count_if(real).alias("unique_keys"), F.count_if(several).alias("clusters"), extra(several).alias("extra"), F.count_if(across).alias("across"), extra(across).alias("across_extra"), F.count_if(within).alias("within"), extra(within).alias("within_extra"))


def parser_rules() -> dict[str, Column]:
    """Rules of the report on parsed questions (stem, options, kind, answer_key, explanation)."""
    fill, letters = F.col("kind") == "fill", F.filter(F.split("answer_key", ""), lambda k: k != "")
    known = F.forall(letters, lambda k: F.exists("options", lambda o: o["key"] == k)) & (F.size(letters) > 0)
    return {
        "no_stem": F.col("stem") == "",
        "few_options": ~fill & (F.size("options") < 2),
        "no_answer": F.coalesce("answer_key", F.lit("")) == "",
        "no_explanation": ~fill & (F.coalesce("explanation", F.lit("")) == ""),
        "answer_not_in_options": ~fill & ~known,
    }
