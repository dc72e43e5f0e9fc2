"""Line dedup: exact and near copies of lines across all documents; the earliest stays.

A line is a \\n-split part of a text; it is compared as its sequence of words. Two lines are near
copies if at most `edits` words (1 or 2) are inserted, deleted or replaced between them and these are
no more than 1 - `similarity` of the words of the shorter; they are exact copies if they are equal up
to blanks at their ends, whatever their length. A line goes if an earlier line, by (row, line number),
is its exact or near copy, whether or not that line itself goes. Rows are ordered by doc_id.

Method: deletion neighbourhood. Each line emits its own hash and the hashes of the line without any
one (or two) of its words. Two lines are at distance d or less exactly if they share such a variant
with at most d deletions between them, or one with deletions at the same place on both sides
(replacements). So grouped minima over the variants, with and without the places, find for each line
its earliest partner without listing the pairs of a group; the partner's words then verify the distance.
Only lines with a possible partner emit variants: of `edits` + 1 parts of the shorter line one stays as
it is, so lines whose parts occur nowhere else can have none. That filter loses nothing.
Hashes of variants come from prefix sums of a linear hash (a running window over the words of a
line), so a line costs its length at one edit; at two edits it costs its length's square.

All steps are built-in expressions, grouped aggregates and equi-joins; hot keys fold in partial
aggregates, and joins on them can be split by adaptive execution.

Edge cases: a null text stays null and has no lines; blank lines always stay. A row is named by its id
and its text, so rows with null or repeated ids keep lines of their own: null ids come first, and rows
of one id are ordered by a hash of their text. Rows equal in both share their fate (all keep the lines
that one of them keeps). An empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from decimal import Decimal
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.llm.common import BLANK_RUN, BLANKS, checked_broadcast, let, materialize

EDITS = 1
SIMILARITY = 0.8
_MODULUS = (1 << 31) - 1


def min_words(edits: int, similarity: float = SIMILARITY) -> int:
    """Words that the shorter of two lines needs for so many edits to be within the similarity."""
    return ceil(edits / (1 - similarity) - 1e-9)


def row_names(docs: DataFrame) -> dict[str, Column]:
    """doc, ra, rb: a row of `docs` by its id and 128 bits of its text."""
    doc_id, text = docs["doc_id"].cast("long"), docs["text"]
    return {"doc": F.coalesce(doc_id, F.lit(0).cast("long")), "ra": F.xxhash64(doc_id.isNull(), text), "rb": F.xxhash64(F.lit("row"), text)}


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc, ra, rb, place, line_no, line, a, b) of every line that is not blank.

    `place` orders lines by (row, line number) in one number, which hash aggregates can hold; a and b
    name the line, without the blanks at its ends, by 128 bits.
    """
    number = lambda x: F.lit(Decimal(x)).cast("decimal(38,0)")
    # a row with an id: id, 31 bits of its text's hash, line; below them those without: 64 bits of the hash, line
    named = F.col("doc").cast("decimal(19,0)") * F.lit(Decimal(1 << 62)) + F.pmod("ra", F.lit(1 << 31)).cast("decimal(10,0)") * F.lit(Decimal(1 << 31))
    nameless = (F.col("ra").cast("decimal(19,0)") * F.lit(Decimal(1 << 31))).cast("decimal(38,0)") - number((1 << 125) + (1 << 95))
    base = F.when(F.col("no_id"), nameless).otherwise(named.cast("decimal(38,0)"))
    parts = docs.select(docs["doc_id"].isNull().alias("no_id"), *[c.alias(n) for n, c in row_names(docs).items()], F.posexplode(F.split(docs["text"], "\n")).alias("line_no", "line"))
    trimmed = parts.select("doc", "ra", "rb", (base + F.col("line_no")).cast("decimal(38,0)").alias("place"), "line_no", F.btrim("line", F.lit(BLANKS)).alias("line")).where("line <> ''")
    return trimmed.select("*", F.xxhash64("line").alias("a"), F.xxhash64(F.lit("line"), "line").alias("b"))


def _part_names(hashes: Column, edits: int, least: int) -> list[Column]:
    """Names of the parts that a near copy may share: (length of the shorter line, part, hash), null where too short.

    At one edit a first or last half stays; at two a first, middle or last third, the middle one moved by a word at most.
    """
    out = []
    for shorter in range(edits + 1):
        length = F.size(hashes) - shorter
        size = F.floor(length / (edits + 1)).cast("int")
        spans = [(0, F.lit(1), size), (1, F.size(hashes) - (length - edits * size) + 1, length - edits * size)]
        spans += [(2, size + 1 + moved, size) for moved in (-1, 0, 1)] if edits == 2 else []
        out += [F.when(length >= least, F.xxhash64(length, F.lit(side), F.slice(hashes, start, n))) for side, start, n in spans]
    return out


def distinct_lines(docs: DataFrame, edits: int = EDITS, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b, first, c, n, parts): every distinct line, its first place, its copies, its words and the names of its parts."""
    least = min_words(1, similarity)
    split = lines_of(docs).select("place", "a", "b", F.split("line", BLANK_RUN).alias("w"))
    names = F.when(F.size("w") >= least, let(F.transform("w", lambda x: F.xxhash64(x)), lambda h: F.array(*[n for e in range(1, edits + 1) for n in _part_names(h, e, min_words(e, similarity))])))
    named = split.select("place", "a", "b", F.size("w").alias("n"), names.alias("h"))
    k = sum((e + 1) * (2 if e == 1 else 5) for e in range(1, edits + 1))
    flat = named.select("place", "a", "b", "n", *[F.get("h", i).alias(f"h{i}") for i in range(k)])
    # words and parts follow from the line; any of the equal values serves
    folded = flat.groupBy("a", "b").agg(F.min("place").alias("first"), F.count("*").alias("c"), F.max("n").alias("n"), *[F.max(f"h{i}").alias(f"h{i}") for i in range(k)])
    return folded.select("a", "b", "first", "c", "n", F.array_distinct(F.array_compact(F.array(*[f"h{i}" for i in range(k)]))).alias("parts"))


def possible_partners(lines: DataFrame) -> DataFrame:
    """(a, b, first) of the lines of which some part's name occurs in another line."""
    named = lines.select("a", "b", "first", F.explode("parts").alias("part"))
    shared = materialize(named.groupBy("part").agg(F.count("*").alias("c")).where("c > 1").select("part"), "line-parts")
    return named.join(checked_broadcast(shared), "part").select("a", "b", "first").distinct()


def _variants(chosen: DataFrame, edits: int) -> DataFrame:
    """(rank, deleted, p, q, variant): each line, and it without any one or two words.

    p and q are the places of the deleted words among those that stay (-1: none). A variant is named by a
    linear hash: the sum of word hash times a coefficient of its position, modulo 2**31 - 1, twice with
    other coefficients.
    """
    m = F.lit(_MODULUS).cast("long")
    word = chosen.select("rank", F.size("w").alias("n"), F.posexplode("w").alias("i", "word"))
    moves = range(edits + 1)
    columns = []
    for c in ("x", "y"):
        h = F.pmod(F.xxhash64(F.lit(c), "word"), m)
        columns += [(h * F.pmod(F.xxhash64(F.lit(c + "i"), F.col("i") - k), m) % m).alias(f"{c}{k}") for k in moves]
    word = word.select("rank", "n", "i", *columns)
    until, every = Window.partitionBy("rank").orderBy("i"), Window.partitionBy("rank")
    # without k words before it, a word's coefficient is that of the position k to the left
    sums = word.select("rank", "n", "i", *[f"{c}{k}" for c in "xy" for k in moves], *[F.sum(f"{c}{k}").over(until).alias(f"{c}b{k}") for c in "xy" for k in moves], *[F.sum(f"{c}{k}").over(every).alias(f"{c}t{k}") for c in "xy" for k in moves[1:]])
    name = lambda x, y: (x % m) * F.lit(1 << 31).cast("long") + y % m
    row = lambda deleted, p, q, variant: F.struct(F.lit(deleted).alias("deleted"), p.alias("p"), q.alias("q"), variant.alias("variant"))
    none = F.lit(-1)
    one = row(1, F.col("i"), none, name(*[F.col(f"{c}b0") - F.col(f"{c}0") + F.col(f"{c}t1") - F.col(f"{c}b1") for c in "xy"]))
    own = F.when(F.col("i") == F.col("n") - 1, row(0, none, none, name(F.col("xb0"), F.col("yb0"))))
    out = sums.select("rank", F.inline(F.array_compact(F.array(one, own))))
    if edits == 2:
        first = sums.select("rank", F.col("i").alias("p"), *[(F.col(f"{c}b0") - F.col(f"{c}0") - F.col(f"{c}b1")).alias(f"{c}p") for c in "xy"])
        second = sums.select("rank", "i", *[(F.col(f"{c}b1") - F.col(f"{c}1") + F.col(f"{c}t2") - F.col(f"{c}b2")).alias(f"{c}q") for c in "xy"])
        both = first.join(second, "rank").where("p < i")
        out = out.unionByName(both.select("rank", F.lit(2).alias("deleted"), "p", (F.col("i") - 1).alias("q"), name(*[F.col(f"{c}p") + F.col(f"{c}q") for c in "xy"]).alias("variant")))
    return out


def _earlier(keyed: DataFrame, keys: list[str], may_meet: dict[int, list[int]], name: str) -> DataFrame:
    """(rank, least): the earliest line that shares `keys` with a line, if it comes before.

    `may_meet` tells, for the deletions of one side, those of the other.
    """
    kinds = sorted({d for ds in may_meet.values() for d in ds})
    minima = keyed.groupBy(*keys).agg(*[F.min(F.when(F.col("deleted") == d, F.col("rank"))).alias(f"m{d}") for d in kinds], F.count("*").alias("c")).where("c > 1").drop("c")
    minima = checked_broadcast(materialize(minima, name))
    # `least` skips nulls and needs two columns
    of = lambda ds: F.least(*[F.col(f"m{d}") for d in ds], F.lit(None).cast("long"))
    partner = F.coalesce(*[F.when(F.col("deleted") == d, of(ds)) for d, ds in may_meet.items()])
    return keyed.join(minima, keys).select("rank", partner.alias("least")).where("rank > least")


def _pairs(variants: DataFrame, edits: int) -> DataFrame:
    """(rank, least): lines and their earliest partners at word distance `edits` or less, by hashes."""
    # at most `edits` deletions between both sides
    few = {d: list(range(edits - d + 1)) for d in range(edits + 1)}
    out = _earlier(variants.select("rank", "deleted", "variant"), ["variant"], few, "line-deleted")
    # every edit replaces a word
    replaced = variants.where(F.col("deleted") == edits)
    out = out.unionByName(_earlier(replaced, ["variant", "p", "q"], {edits: [edits]}, "line-replaced"))
    if edits == 2:  # one word replaced, another deleted
        places = variants.where("deleted > 0").select("rank", "deleted", "variant", F.explode(F.array_distinct(F.filter(F.array("p", "q"), lambda x: x >= 0))).alias("p"))
        out = out.unionByName(_earlier(places, ["variant", "p"], {1: [2], 2: [1]}, "line-mixed"))
    return out


def _near(one: Column, other: Column, edits: int) -> Column:
    """Whether two word sequences are at edit distance `edits` or less."""

    def common(a: Column, b: Column) -> Column:
        step = lambda acc, e: F.struct((acc["n"] + (acc["go"] & e).cast("int")).alias("n"), (acc["go"] & e).alias("go"))
        return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")), step)["n"]

    def middles(a: Column, b: Column) -> Column:
        """Nothing is common at either end of these: an edit is at each."""
        equal = []
        for a1, b1 in ((1, 1), (1, 0), (0, 1)):
            for a2, b2 in ((1, 1), (1, 0), (0, 1)):
                n = F.size(a) - a1 - a2
                equal.append((n >= 0) & (n == F.size(b) - b1 - b2) & (F.slice(a, a1 + 1, F.greatest(n, F.lit(0))) == F.slice(b, b1 + 1, F.greatest(n, F.lit(0)))))
        near = F.greatest(F.size(a), F.size(b)) <= edits
        for e in equal if edits == 2 else []:
            near = near | e
        return near

    def behind(p: Column) -> Column:
        rest = lambda x: F.slice(x, p + 1, F.size(x))
        return let(common(F.reverse(rest(one)), F.reverse(rest(other))), lambda s: let(F.struct(F.slice(rest(one), F.lit(1), F.size(one) - p - s).alias("x"), F.slice(rest(other), F.lit(1), F.size(other) - p - s).alias("y")), lambda r: middles(r["x"], r["y"])))

    return let(common(one, other), behind)


def near_copies(docs: DataFrame, lines: DataFrame, edits: int = EDITS, similarity: float = SIMILARITY) -> DataFrame:
    """Keys (a, b) of the distinct lines that have an earlier near copy."""
    wanted = checked_broadcast(materialize(possible_partners(lines), "line-candidates").withColumnRenamed("first", "place"))
    texts = lines_of(docs).select("a", "b", "place", "line").join(wanted, ["a", "b", "place"]).dropDuplicates(["a", "b"])
    ranked = texts.orderBy("place").select("a", "b", F.monotonically_increasing_id().alias("rank"), F.split("line", BLANK_RUN).alias("w"))
    chosen = materialize(ranked, "line-words")  # written once, so ranks stay; they rise with the place
    words = checked_broadcast(chosen)
    left = words.select("rank", "a", "b", F.col("w").alias("wa"))
    right = words.select(F.col("rank").alias("least"), F.col("w").alias("wb"))
    found = []
    for e in range(1, edits + 1):
        variants = materialize(_variants(chosen.where(F.size("w") >= min_words(e, similarity)), e), "line-variants")
        pairs = _pairs(variants, e).distinct()
        found.append(pairs.join(left, "rank").join(right, "least").where(_near(F.col("wa"), F.col("wb"), e)).select("a", "b"))
    return (found[0] if edits == 1 else found[0].unionByName(found[1])).distinct()


def dropped_lines(docs: DataFrame, edits: int = EDITS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc, ra, rb, dropped): the sorted line numbers that go, for each row that loses lines."""
    lines = materialize(distinct_lines(docs, edits, similarity), "lines")
    near = near_copies(docs, lines, edits, similarity).withColumn("near", F.lit(True))
    # a line that occurs once and has no earlier near copy stays; only the others are looked up
    fate = materialize(lines.select("a", "b", "first", "c").join(near, ["a", "b"], "left").where("near OR c > 1").drop("c"), "line-fate")
    gone = lines_of(docs).drop("line").join(checked_broadcast(fate), ["a", "b"]).where("near OR place <> first")
    return gone.groupBy("doc", "ra", "rb").agg(F.array_sort(F.collect_set("line_no")).alias("dropped"))


def _without(lines: Column, dropped: Column) -> Column:
    """`lines` without the sorted positions `dropped`."""

    def between(j: Column) -> Column:
        before = F.when(j > 0, F.get(dropped, j - 1)).otherwise(-1)
        after = F.coalesce(F.get(dropped, j), F.size(lines))
        return F.slice(lines, before + 2, after - before - 1)

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(dropped)), between))


def dedup_lines(docs: DataFrame, edits: int = EDITS, similarity: float = SIMILARITY) -> DataFrame:
    """`docs` with `text` rebuilt from the lines that stay, and `dropped_lines`, the line numbers that went.

    A column that has the name `dropped_lines` already is replaced. `edits` is 1 or 2.
    """
    gone = checked_broadcast(materialize(dropped_lines(docs, edits, similarity), "dropped-lines"))
    same = [row == gone[name] for name, row in row_names(docs).items()]
    joined = docs.join(gone, same, "left")
    kept = let(F.split(docs["text"], "\n"), lambda x: F.array_join(_without(x, gone["dropped"]), "\n"))
    text = F.when(gone["dropped"].isNull(), docs["text"]).otherwise(kept).alias("text")
    return joined.select(*[text if c == "text" else docs[c] for c in docs.columns if c != "dropped_lines"], F.coalesce(gone["dropped"], F.array().cast("array<int>")).alias("dropped_lines"))
