"""The pipeline's stages: what each keeps, its columns, and its odd inputs."""

import random

import pytest

import corpus_pipeline
from tallyloom.llm import components, decontaminate, line_dedup, quality_rules, queries, shingles, simhash
from tallyloom.llm.queries import with_trust
from tallyloom.sources import shared

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf_small, tmp_path_factory):
    top = tmp_path_factory.mktemp("stages")
    frames = [spark.read.parquet(f"{sf_small}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, frames[-1], sf_small).write.parquet(f"{top}/{name}")
        frames.append(spark.read.parquet(f"{top}/{name}"))
    return frames


def test_columns(stages):
    assert all(f.columns == COLUMNS for f in stages[:-1])
    assert "ids" in stages[-1].columns


def test_quality_stage(spark, sf_small, stages):
    rules = quality_rules.apply_rules(stages[0], quality_rules.fit_ratios(with_trust(spark, stages[0], sf_small), __import__("pyspark").sql.functions.col("trusted")))
    assert {r.doc_id for r in stages[1].collect()} == {r.doc_id for r in rules.where("kept").collect()}


def test_line_stage(stages):
    want = {r.doc_id: r.text for r in line_dedup.dedup_lines(stages[1]).collect() if not r.dropped_lines or r.text.strip()}
    assert {r.doc_id: r.text for r in stages[2].collect()} == want
    assert all(r.n_chars == len(r.text) for r in stages[2].collect())


def test_simhash_stage_keeps_one_of_each_group(stages):
    assert {r.doc_id for r in stages[3].collect()} == {r.component_id for r in simhash.near_duplicates(stages[2]).collect()}


def test_decontamination_stage(spark, sf_small, stages):
    bad = {r.doc_id for r in decontaminate.leaks(stages[3], spark.read.parquet(f"{sf_small}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in stages[4].collect()} == {r.doc_id for r in stages[3].collect()} - bad


def test_encoding_stage_and_run(spark, sf_small, stages):
    rows = stages[5].collect()
    assert all(r.round_trip and r.n_pieces == len(r.ids) for r in rows) and len(rows) == stages[4].count()
    assert sorted(corpus_pipeline.run(spark, sf_small).select("doc_id", "n_pieces").collect()) == sorted(stages[5].select("doc_id", "n_pieces").collect())


@pytest.mark.parametrize("k", range(5))
def test_odd_documents(spark, sf_small, k):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "plain words " * 30, "en", None, 1), (3, "tie " * 5, "en", "s", 1), (4, "one two three four five six\n" * 2, "en", "s", 1)]
    name, stage = corpus_pipeline.STAGES[k]
    docs = spark.createDataFrame(rows, schema)
    assert stage(spark, docs, sf_small).count() <= len(rows), name
    assert stage(spark, docs.where("false"), sf_small).count() == 0, name


def test_near_stage_reaches_four_fifths_of_five_word_shingles(spark, sf_small):
    rng, rows = random.Random(6), []
    for base in range(60):
        words = [f"b{base}w{i}" for i in range(rng.choice((40, 90, 200)))]
        rows.append(" ".join(words))
        for _ in range(3):
            copy = list(words)
            for at in rng.sample(range(len(copy)), rng.randint(1, 1 + len(copy) // 40)):
                copy[at : at + 1] = rng.choice(([], ["new"], ["new", "word"]))
            rows.append(" ".join(copy))
    rng.shuffle(rows)
    parts = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in rows]
    alike = [[len(x & y) >= 0.8 * len(x | y) for y in parts] for x in parts]
    prints = [simhash.fingerprint(t.encode()) % (1 << 64) for t in rows]
    far = sum(alike[i][j] and (prints[i] ^ prints[j]).bit_count() > simhash.BITS for i in range(len(rows)) for j in range(i))
    assert far > 20  # pairs that fingerprints at 4 bits leave apart
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (alike[i][j] or (prints[i] ^ prints[j]).bit_count() <= simhash.BITS) and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id for r in corpus_pipeline.simhash_stage(spark, docs, sf_small).collect()}
    assert got == set(group)


def test_stages_drop_only_the_row_found(spark, sf_small):
    item = spark.read.parquet(f"{sf_small}/benchmark.parquet").where("item_id IS NOT NULL AND text IS NOT NULL").orderBy("item_id").first().text
    copy, clean, other = "some words that occur in two rows of this table", "clean text one", "another text that is clean"
    rows = [(1, copy), (None, copy), (None, clean), (7, other), (7, copy), (None, item), (None, "null copies"), (None, "null copies")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    read = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    near = corpus_pipeline.simhash_stage(spark, docs, sf_small)
    assert read(near) == sorted([(1, copy), (None, clean), (7, other), (None, item), (None, "null copies")], key=str)
    assert read(corpus_pipeline.decontamination_stage(spark, docs, sf_small)) == sorted([r for r in rows if r[1] != item], key=str)


def test_no_table_over_the_bound_is_broadcast(spark, sf_small, monkeypatch):
    """With every table over the bound, stages broadcast nothing, however small Spark takes the files for."""
    plans = []
    whole, bounded = shared.materialize, shared.checked_broadcast

    def planned(df, name):
        plans.append((name, df._jdf.queryExecution().sparkPlan().toString()))
        return whole(df, name)

    for module in (corpus_pipeline, components, decontaminate, line_dedup, quality_rules, queries, shingles, simhash):
        for name, value in (("materialize", planned), ("checked_broadcast", lambda df, *_: bounded(df, -1)), ("BROADCAST_BYTES", -1)):
            if hasattr(module, name):
                monkeypatch.setattr(module, name, value)
    docs = shared.materialize(spark.read.parquet(f"{sf_small}/documents.parquet").limit(60), "few")
    for name, stage in corpus_pipeline.STAGES[:4]:
        planned(stage(spark, docs, sf_small), name)
    assert {name for name, plan in plans if "BroadcastHashJoin" in plan} == set() and sum("SortMergeJoin" in plan for _, plan in plans) > 10
