"""Search by posting lists: rows that hold all q-grams of the keywords, verified and scored as `retrieval.search` does.

A posting is (id, position, bits) in a list of its gram: the row has the gram in the fields that the bits name, START if its stem begins with
it. Grams start at every character, so those at the end of a field are shorter, and a keyword shorter than a gram is a prefix of one.
Each file has the lists of some of the rows, sorted by gram: postings are gathered where they are made and never shuffled, a search
reads only the parts of the files that hold its grams, and a gram of all rows is no single part. Of long keywords the first gram and the few rarest are looked up.

The fields common to the grams of each keyword bound a row's score from above. The rows with the highest bounds are
scored first; of the others only those whose bound reaches the last score found, so a common word does not cost scoring every row.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import retrieval
from tallyloom.sources.shared import checked_broadcast, materialize, shared_dir

GRAM = 3
#: Grams of a keyword that are looked up beside the first.
RARE = 3
#: Rows scored first, for each row asked.
AHEAD = 4
START = 1 << 6
#: Postings that are gathered into lists at once, about.
POSTINGS = 1_000_000
#: Bit and points of every field.
FIELDS = {"stem": (1, retrieval.STEM), "headword": (2, retrieval.HEADWORD), "translation": (4, retrieval.TRANSLATION), "explanation": (8, retrieval.EXPLANATION), "tags": (16, retrieval.TAG), "grammar_points": (32, retrieval.POINT)}
LISTS = ("tags", "grammar_points")


def grams_of(word: str, q: int = GRAM) -> list[str]:
    """Whole grams of a keyword, the first one first; none for a shorter keyword."""
    return list(dict.fromkeys(word[i : i + q] for i in range(len(word) - q + 1)))


def postings(questions: DataFrame, q: int = GRAM) -> DataFrame:
    """(gram, rows array<struct<id, position, bits>>): the rows of a part of the bank that have the gram, each once; grams of lower-cased fields, from each of their characters on."""
    held = [name for name in FIELDS if name in questions.columns]
    lowered = questions.select("id", "position", *[(F.transform(name, F.lower) if name in LISTS else F.lower(name)).alias(name) for name in held])
    kind = lambda name: questions.schema[name].dataType.simpleString()

    def put(found: dict[str, tuple[list, list]], batch: pa.RecordBatch) -> pa.RecordBatch:
        said = sorted(found)
        at = pa.array([k for g in said for k in found[g][0]], pa.int64())
        bits = pa.array([x for g in said for x in found[g][1]], pa.int32())
        rows = pa.StructArray.from_arrays([batch["id"].take(at), batch["position"].take(at), bits], ["id", "position", "bits"])
        ends = list(accumulate((len(found[g][0]) for g in said), initial=0))
        return pa.RecordBatch.from_arrays([pa.array(said, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)], ["gram", "rows"])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, n = defaultdict(lambda: ([], [])), 0
            columns = [(name, FIELDS[name][0], batch[name].to_pylist()) for name in held]
            for k in range(batch.num_rows):
                own: dict[str, int] = {}
                for name, bit, values in columns:
                    texts = (values[k] or []) if name in LISTS else [values[k]]
                    for g in {text[i : i + q] for text in texts if text for i in range(len(text))}:
                        own[g] = own.get(g, 0) | bit
                    if name == "stem" and values[k]:
                        own[values[k][:q]] |= START
                for g, bits in own.items():
                    at, said = found[g]
                    at.append(k)
                    said.append(bits)
                n += len(own)
                if n >= POSTINGS:
                    yield put(found, batch)
                    found, n = defaultdict(lambda: ([], [])), 0
            yield put(found, batch)

    return lowered.mapInArrow(made, f"gram string, rows array<struct<id: {kind('id')}, position: {kind('position')}, bits: int>>")


@dataclass
class SearchIndex:
    """Posting lists and gram counts in a folder, in segments: one for each set of rows that was added."""

    spark: SparkSession
    root: str
    q: int = GRAM
    report: dict[str, int] = field(default_factory=dict)

    def add(self, questions: DataFrame) -> SearchIndex:
        """Writes a segment for new rows; older segments stay as they are."""
        name = uuid.uuid4().hex
        path = f"{self.root}/postings/{name}"
        kept = [c for c in ("id", "position", *FIELDS) if c in questions.columns]
        spread = questions.select(*kept).repartition(4 * self.spark.sparkContext.defaultParallelism)  # texts are dealt out, not their many more postings
        postings(spread, self.q).sortWithinPartitions("gram").write.parquet(path)
        counts = self.spark.read.parquet(path).groupBy("gram").agg(F.sum(F.size("rows")).alias("n"))
        counts.sortWithinPartitions("gram").write.parquet(f"{self.root}/counts/{name}")
        return self

    def _lookup(self, words: list[str]) -> dict[str, list[str]]:
        """For each keyword the grams to look up."""
        asked = sorted({g for w in words for g in grams_of(w, self.q)})
        if not asked:
            return {w: [] for w in words}
        rows = self.spark.read.parquet(f"{self.root}/counts/*").where(F.col("gram").isin(asked)).groupBy("gram").agg(F.sum("n").alias("n")).collect()
        n = {r["gram"]: r["n"] for r in rows}
        pick = lambda own: list(dict.fromkeys([*own[:1], *sorted(own, key=lambda g: (n.get(g, 0), g))[:RARE]]))
        return {w: pick(grams_of(w, self.q)) for w in words}

    def candidates(self, words: list[str]) -> DataFrame:
        """(id, position, bound, touched): rows that may hold every keyword, the highest score they can reach, and their postings read."""
        looked, times = self._lookup(list(dict.fromkeys(words))), Counter(words)
        conditions, masks, points = [], [], F.lit(0)
        for k, (word, own) in enumerate(looked.items()):
            tests = [F.col("gram") == g for g in own] or [F.startswith("gram", F.lit(word))]
            conditions += tests
            masks += [F.bit_or(F.when(t, F.col("bits"))).alias(f"m{k}_{j}") for j, t in enumerate(tests)]
            common = reduce(lambda a, b: a.bitwiseAND(b), [F.coalesce(F.col(f"m{k}_{j}"), F.lit(0)) for j in range(len(tests))])
            starts = F.coalesce(F.col(f"m{k}_0"), F.lit(0)).bitwiseAND(F.lit(START)) != 0  # the first gram, or any that the keyword begins
            score = sum((F.when(common.bitwiseAND(F.lit(bit)) != 0, p).otherwise(0) for bit, p in FIELDS.values()), F.lit(0))
            score = score + F.when(starts & (common.bitwiseAND(F.lit(1)) != 0), retrieval.STEM_START).otherwise(0)
            points = F.when(common.bitwiseAND(F.lit(START - 1)) != 0, points + score * times[word])  # null: a keyword is missing
        read = self.spark.read.parquet(f"{self.root}/postings/*").where(reduce(lambda a, b: a | b, conditions)).select("gram", F.inline("rows"))
        rows = read.groupBy("id", "position").agg(*masks, F.count("*").alias("touched"))
        return rows.withColumn("bound", points).where("bound IS NOT NULL").select("id", "position", "bound", "touched")

    def search(self, questions: DataFrame, query: str, limit: int = 50) -> DataFrame:
        """As `retrieval.search`(questions, query, limit); `questions` has the rows that were added. `report` tells what was read."""
        words = retrieval.keywords(query)
        if not words:
            return retrieval.search(questions, query, limit)
        found = materialize(self.candidates(words), "candidates")
        n, touched = found.agg(F.count("*"), F.coalesce(F.sum("touched"), F.lit(0))).first()
        first = [r[0] for r in found.orderBy(F.desc("bound"), "position").limit(AHEAD * limit).select("id").collect()]
        ahead = questions.where(F.col("id").isin(first))
        self.report = {"candidates": n, "postings": touched, "scored": len(first)}
        if n <= AHEAD * limit:
            return retrieval.search(ahead, query, limit)
        best = materialize(retrieval.search(ahead, query, limit), "scored")
        kth = best.agg(F.when(F.count("*") == limit, F.min("score"))).first()[0] or 0
        rest = found.where((F.col("bound") >= kth) & ~F.col("id").isin(first)).select(F.col("id").alias("_id"))
        self.report["scored"] += rest.count()
        more = questions.join(checked_broadcast(rest), F.col("id") == F.col("_id"), "left_semi")
        return best.unionByName(retrieval.search(more, query, limit)).orderBy(F.desc("score"), "position").limit(limit)


def build(questions: DataFrame, root: str | None = None, q: int = GRAM) -> SearchIndex:
    spark = questions.sparkSession
    return SearchIndex(spark, root or f"{shared_dir(spark)}/search-{uuid.uuid4().hex}", q).add(questions)
