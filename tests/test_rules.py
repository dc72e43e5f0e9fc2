"""Rules as a table give the tags of rules one by one."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyloom.functions import text
from tallyloom.operators import rules


@pytest.mark.parametrize(
    ("pattern", "want"),
    [
        ("抗日战争|九一八|七七", ["七七", "九一八", "抗日战争"]),
        ("中共[一大二]", ["中共"]),
        ("(?i)Licen[sc]e", ["licen"]),
        ("a+b", ["a"]),
        ("(?:abc|de)+x?", ["abc", "de"]),
        ("[ab]", ["a", "b"]),
        ("x?|y", None),
        ("[0-9]{3,}", None),
        ("(?=abc)", None),
        ("\\p{L}+", None),
        ("(", None),
        ("", None),
        ("(?:a|b)?longer", ["longer"]),
        ("[^a]word", ["word"]),
        ("(?x) a b", None),
    ],
)
def test_needed(pattern, want):
    assert rules.needed(pattern) == want


def many(n, seed=2):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé漢") for _ in range(rng.randint(1, 6)))
    shapes = [lambda: word(), lambda: f"{word()}|{word()}", lambda: f"(?i){word()}[{word()}]", lambda: f"({word()}|{word()})+{word()}?", lambda: f"^{word()}", lambda: "[0-9]{2}", lambda: f"{word()}.{word()}"]
    return [(f"n{rng.randrange(n)}", rng.choice(shapes)()) for _ in range(n)]


def test_table_of_rules_equals_rules_one_by_one(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice("abcdeé漢 AB\n17") for _ in range(rng.choice((0, 3, 40, 300)))) for _ in range(120)] + [None, "", "X" * 3000]
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "id long, text string, rule int, gram string")
    listed = many(60)
    want = {r.id: r.tags for r in frame.select("id", F.coalesce(text.match_tags(F.col("text"), listed), F.array().cast("array<string>")).alias("tags")).collect()}
    assert {r.id: r.tags for r in rules.tag_texts(frame, listed).collect()} == want and any(want.values())
    assert all(r.tags == [] for r in rules.tag_texts(frame, []).collect())


def test_plan_does_not_grow_with_the_rules(spark):
    frame = spark.createDataFrame([(1, "abc")], "id long, text string")
    size = lambda n: len(rules.tag_texts(frame, [(f"n{k}", f"word{k}x") for k in range(n)])._jdf.queryExecution().optimizedPlan().toString())  # noqa: E731, SLF001
    assert abs(size(2000) - size(20)) < 200


@pytest.mark.parametrize(
    ("pattern", "want"),
    [
        ("(?i)Ab[cd]|é", (False, ["abc", "abd", "é"])),
        ("(?:a|b)[xy]z", (True, ["axz", "ayz", "bxz", "byz"])),
        ("中共[一大]", (True, ["中共一", "中共大"])),
        ("a|", None),
        ("ab?", None),
        ("a.b", None),
        ("[a-c]", None),
        ("(?u)a", None),
        ("[ab][ab][ab][ab][ab][ab][ab]", None),
    ],
)
def test_spelled(pattern, want):
    assert rules.spelled(pattern) == want


def test_fixed_texts_are_found_without_moving_the_texts(spark, monkeypatch):
    """Rules that match a few texts only need no join of texts with rules; long texts are cut, and what lies over a cut is found."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abAé漢😀") for _ in range(rng.randint(1, 9)))
    listed = [(f"n{k % 40}", f"{rng.choice(('', '(?i)'))}{word()}|{word()}[{word()}]") for k in range(80)]
    texts = ["".join(rng.choice("abAéÉ漢😀") for _ in range(rng.choice((0, 2, 30, 500)))) for _ in range(60)] + [None]
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    want = {r.id: r.tags for r in frame.select("id", F.coalesce(text.match_tags(F.col("text"), listed), F.array().cast("array<string>")).alias("tags")).collect()}
    found = rules.tag_texts(frame, listed)
    plan = found._jdf.queryExecution().executedPlan().toString()  # noqa: SLF001
    assert "Exchange" not in plan and "Join" not in plan
    assert {r.id: r.tags for r in found.collect()} == want and any(want.values())
    monkeypatch.setattr(rules, "STRETCH", 7)
    frame = pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "said": texts})
    said = [(x, k, cased) for k, (_, p) in enumerate(listed) for cased, own in [rules.spelled(p)] for x in own]
    cut = next(rules._tagger(said, [n for n, _ in listed])(iter([frame]))).to_pylist()
    assert [list(dict.fromkeys(x["name"] for x in r["found"])) for r in cut] == [want[r["id"]] for r in cut]
