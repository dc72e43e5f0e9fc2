"""Posting lists give the rows of a full search."""

import random

import pytest

from tallyloom.operators import retrieval, search_index

SCHEMA = "id long, position long, stem string, tags array<string>, grammar_points array<string>, explanation string, extra int"


def bank(spark, n, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdÉ漢") for _ in range(rng.randint(1, 6)))
    some = lambda k: " ".join(word() for _ in range(rng.randint(0, k)))
    rows = [(i, i, some(12), [word() for _ in range(rng.randint(0, 3))], rng.choice([None, [word(), None], []]), rng.choice([None, some(6)]), 0) for i in range(n)]
    rows += [(n, n, None, None, None, None, 0), (n + 1, n + 1, "", [], [], "", 0), (n + 2, n + 2, "Abcd abcd", ["abcd"], None, "ABCD", 0)]
    return spark.createDataFrame(rows, SCHEMA)


def listed(rows):
    return [(r.id, r.score) for r in rows.collect()]


def test_index_gives_the_rows_of_a_full_search(spark):
    questions = bank(spark, 600).cache()
    index = search_index.build(questions.where("id % 3 <> 0")).add(questions.where("id % 3 = 0"))
    for query in ("a", "ab", "abc", "É漢", "abcd", "abcd ab", "a b c", "bcda a", "zzz", "ab zz", "", " \t", "ABC abc", "漢", "dab c"):
        want = listed(retrieval.search(questions, query, 7))
        assert listed(index.search(questions, query, 7)) == want, query
        assert len(want) <= 7
    questions.unpersist()


def test_rows_scored_are_few(spark):
    """A word of every row beside one of a few: only the few are scored; the word alone is scored up to its best rows."""
    rows = [(i, i, ("needle " if i % 100 == 0 else "") + "common words here", ["common"] if i < 60 else [], None, None, 0) for i in range(3000)]
    questions = spark.createDataFrame(rows, SCHEMA)
    index = search_index.build(questions)
    assert listed(index.search(questions, "needle common")) == listed(retrieval.search(questions, "needle common"))
    assert index.report["scored"] == index.report["candidates"] == 30
    assert listed(index.search(questions, "common")) == listed(retrieval.search(questions, "common"))
    assert index.report["candidates"] == 3000 and index.report["scored"] <= search_index.AHEAD * 50 + 60
    assert listed(index.search(questions, "common common words")) == listed(retrieval.search(questions, "common common words"))
    assert listed(index.search(questions, "absent")) == [] and index.report["postings"] == 0


def test_postings_are_one_a_gram_and_not_shuffled(spark):
    """A row of the index names all fields with its gram; texts are dealt out before, so what is shuffled goes by the texts and not by their postings."""
    rows = [(i, i, " ".join(f"{(i * 7919 + k * 104729) % 999983:06d}" for k in range(200)), ["ab", None], ["ab"], None, 0) for i in range(300)]
    questions = spark.createDataFrame(rows, SCHEMA)
    shuffled = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()  # noqa: E731, SLF001
    before = shuffled()
    index = search_index.build(questions)
    assert shuffled() - before < 2 * sum(len(r[2]) for r in rows)
    held = spark.read.parquet(f"{index.root}/postings/*").selectExpr("gram", "inline(rows)")
    assert held.groupBy("gram", "id").count().where("count > 1").isEmpty()
    assert {r.bits for r in held.where("gram = 'ab'").collect()} == {16 | 32}
    assert listed(index.search(questions, "ab")) == listed(retrieval.search(questions, "ab"))


@pytest.mark.parametrize(("word", "want"), [("ab", []), ("abc", ["abc"]), ("ababab", ["aba", "bab"])])
def test_grams_of(word, want):
    assert search_index.grams_of(word) == want
