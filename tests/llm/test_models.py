"""Toxicity, quality model and language identification: definitions by brute force, held-out accuracy, odd inputs."""

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import features, language, quality_model, queries, toxicity

MODELS = [(toxicity, "toxic"), (quality_model, "quality")]


def ranked(pairs):
    """Area under the curve of (score, label)."""
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def test_machine_score_is_the_sum_over_all_pairs():
    rng = np.random.default_rng(1)
    model = toxicity.Model(np.arange(6, dtype=np.uint32), 0.3, rng.normal(size=6), rng.normal(size=(6, 3)))
    at = np.array([0, 2, 5])
    z = 0.3 + model.w[at].sum() + sum(model.v[i] @ model.v[j] for k, i in enumerate(at) for j in at[k + 1 :])
    assert model.score(at) == pytest.approx(1 / (1 + np.exp(-z)))


def test_machine_learns_an_interaction():
    """Neither term alone tells; only both together do."""
    rng = random.Random(2)
    rows = [[i for i in range(2) if rng.random() < 0.5] for _ in range(1200)]
    y = np.array([len(r) == 1 for r in rows], dtype=float)
    model = toxicity.fit_machine([np.array(r, dtype=np.int64) for r in rows], y, np.arange(2, dtype=np.uint32), epochs=60)
    assert min(model.score(np.array([k])) for k in (0, 1)) > max(model.score(np.array([0, 1])), model.score(np.array([], dtype=np.int64)))


def test_interacting_terms_are_selected_and_learned(spark):
    """From texts: toxic exactly if one of two words occurs; neither word alone tells anything."""
    rng, rows = random.Random(4), []
    for i in range(2600):
        words = [f"word{rng.randrange(300)}" for _ in range(rng.randint(5, 40))]
        present = [w for w in ("insult", "group") if rng.random() < 0.5]
        for w in present:
            words.insert(rng.randrange(len(words) + 1), w)
        rows.append((i, " ".join(words), int(len(present) == 1)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.col("doc_id") < 2000)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert np.mean([(got[i] >= 0.5) == y for i, _, y in rows[2000:]]) > 0.9


def test_interacting_pairs_equal_brute_force():
    rng = np.random.default_rng(6)
    x = rng.random((400, 9)) < 0.4
    y = (x[:, 0] ^ x[:, 1] | (rng.random(400) < 0.1)).astype(float)

    def g(*terms):
        total = 0.0
        for cell in {tuple(r) for r in x[:, list(terms)].tolist()}:
            inside = (x[:, list(terms)] == cell).all(axis=1)
            for kind in (0, 1):
                seen, expected = (inside & (y == kind)).sum(), inside.sum() * (y == kind).mean()
                total += 2 * seen * np.log(seen / expected) if seen else 0
        return total

    for least in (2.0, 10.0):
        want = {t for i in range(9) for j in range(i) if g(i, j) - g(i) - g(j) >= least for t in (i, j)}
        assert set(toxicity.interacting([np.flatnonzero(r) for r in x], y, 9, least).tolist()) == want


def test_dual_descent_reaches_the_primal_optimum():
    """The dual's weights are as good as the best of many random changes of them."""
    rng = np.random.default_rng(3)
    x = rng.random((80, 6)) < 0.5
    y = np.where(x[:, 0] & ~x[:, 1] | (rng.random(80) < 0.1), 1.0, -1.0)
    rows, scale, cost = [np.flatnonzero(r) for r in x], np.ones(6), np.full(80, 0.3)
    w, bias = quality_model.dual_descent(rows, y, scale, cost, epochs=400)
    loss = lambda w, b: 0.5 * (w @ w + b * b) + (cost * np.maximum(0, 1 - y * (x @ w + b))).sum()
    best = loss(w, bias)
    assert all(best <= loss(w + d[:6], bias + d[6]) + 1e-3 for d in rng.normal(scale=0.05, size=(500, 7)))


def test_log_count_ratios(spark):
    rows = [("up good", 1.0)] * 5 + [("down good", 0.0)] * 5
    ratios = quality_model.log_count_ratios(spark.createDataFrame(rows, "text string, y double"))
    up, down = quality_model.indicators("up"), quality_model.indicators("down")
    assert ratios[up] == pytest.approx(np.log(6)) and ratios[down] == pytest.approx(-np.log(6))


def test_indicators_do_not_depend_on_where_a_text_is_cut(monkeypatch):
    rng = random.Random(7)
    text = " ".join(rng.choice(("a", "b!", "b!", "long-word", "x\ty", "z\n")) for _ in range(3000))
    whole = quality_model.indicators(text).tolist()
    for size in (1, 7, 100):
        monkeypatch.setattr(quality_model, "chunks", lambda data, size=size: features.chunks(data, size))
        assert quality_model.indicators(text).tolist() == whole


@pytest.mark.parametrize("module,label", MODELS)
def test_odd_inputs(spark, module, label):
    texts = [None, "", "bad word", "bad word", "good word", "x " * 60_000, "🙂"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS y", "3 AS k0")
    labels = spark.createDataFrame([(2, 1, 1), (2, 0, 0), (3, 1, 1), (4, 0, 0), (None, 1, 1), (5, None, None), (99, 1, 1)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.where("false"), labels.where("quality = 1")):
        got = module.score(docs, module.fit(docs, known, F.lit(True))).collect()
        assert len(got) == len(texts) and all(0 <= r.score <= 1 for r in got)
    assert module.score(docs.where("false"), module.fit(docs, labels, F.lit(True))).count() == 0


@pytest.mark.parametrize("name,label,least", [("op5_toxicity", "toxic", 0.75), ("op8_quality_model", "quality", 0.9)])
def test_held_out(spark, sf_oracle, name, label, least):
    labels = spark.read.parquet(f"{sf_oracle}/labels.parquet")
    got = queries.QUERIES[name](spark, sf_oracle)
    rows = got.where("held_out").join(labels, "doc_id").select("score", F.col(label) == 1).collect()
    assert ranked(rows) >= least
    assert got.count() == spark.read.parquet(f"{sf_oracle}/documents.parquet").count()


def test_language(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").where("n_chars > 200")
    rows = docs.select("doc_id", "lang", "text").collect()
    wrap = lambda t, lang: f"<html lang='{lang}-x'><head><style>p {{}}</style></head><body><p>{t}</p></body></html>"
    pages = [(r.doc_id, f"https://www.h{r.lang}.example.{r.lang}/{r.lang}/p", wrap(r.text[:150], r.lang)) for r in rows]
    odd = [(-1, None, None), (-2, "not a url", ""), (-3, "https://www.hde.example.de/x", "<html></html>"), (-3, "https://www.hde.example.de/x", "<html></html>"), (None, "", "<p>" + "x " * 100_000)]
    table = spark.createDataFrame([*pages, *odd], "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS soft")
    got = language.identify(table, docs).collect()
    assert len(got) == len(pages) + len(odd)
    found = {r.page_id: r.language for r in got}
    assert np.mean([found[r.doc_id] == r.lang for r in rows]) > 0.98
    assert all(0 < r.confidence <= 1 for r in got)
    if "de" in {r.lang for r in rows}:
        assert found[-3] == "de"  # no text: the host decides
    assert language.identify(table.where("false"), docs).count() == 0
    assert {r.language for r in language.identify(table, docs.where("false")).collect()} == {None}


PAGES = ["<p>a</p>", "a<!--x--><b>c", "<script>x</script  >y", "<STYLE a>x</style>y<sCript>z", "a < b > c", "<!-- x", "<!-- <b> c -->d<!-- e > f", "<<>>", "<scripty>x</script>", "<!---->a", "<!-->a-->", "a<script", "</style>a", "", "<", "x<script>a<!--b</script>c-->d"]


def test_visible_text_equals_the_definition():
    definition = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")
    rng = random.Random(3)
    parts = ["<", ">", "<!--", "-->", "<script", "</script>", "<style>", "</style", " ", "x", "<b>", "--", "!"]
    for page in [*PAGES, *["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)]]:
        assert language.unmarked(page) == definition.sub(" ", page), page


def test_declared_language_equals_the_definition():
    definition = re.compile(r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})")
    rng = random.Random(4)
    parts = ["<html", " ", "lang", "=", "'", "en", ">", "xml:", "DE", "<HTML", "l"]
    for page in ["".join(rng.choice(parts) for _ in range(rng.randint(0, 16))) for _ in range(5000)]:
        found = definition.search(page)
        assert language.declared_language(page) == (found[1].lower() if found else ""), page


@pytest.mark.parametrize("mark", ["<!--", "<script", "<style>", "<html", "<", "<html lang", "&", "</script", "<!-- >", "<script>x>"])
def test_hostile_pages_take_linear_time(mark):
    page = mark * (1_000_000 // len(mark))
    began = time.perf_counter()
    language.visible(page), language.declared_language(page)
    assert time.perf_counter() - began < 3


def test_posterior_equals_brute_force(spark):
    """The whole fusion again in plain numbers, from the text evidence on."""
    rng = random.Random(5)
    docs = spark.createDataFrame([(lang, " ".join(rng.choice(words) for _ in range(60))) for lang, words in (("de", ["der", "und", "nicht"]), ("en", ["the", "and", "not"]), ("fr", ["le", "et", "pas"])) for _ in range(5)], "lang string, text string")
    hosts = ["a.x.de", "b.x.de", "c.en", "d.fr", "www.d.fr"]
    rows = []
    for i in range(60):
        url = rng.choice((None, "nonsense", f"https://{rng.choice(hosts)}/{rng.choice(('de', 'en', 'page', ''))}/p"))
        rows.append((i, url, f"<html{rng.choice(('', ' lang=de', ' lang=en-GB'))}><p>{' '.join(rng.choice(('der', 'the', 'le', 'und', 'and')) for _ in range(rng.randint(0, 4)))}</p>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in language.identify(pages, docs).collect()}
    names, logs = language.fit_text(docs)
    pick = lambda pattern, url: (m[1] if (m := re.search(pattern, url or "")) else "").lower()
    seen = []
    for i, url, page in rows:
        text = np.array(language.text_evidence(page, logs))
        host = pick(r"^[a-z]+://([^/]*)", url)
        soft = np.exp(text - np.logaddexp.reduce(text))
        seen.append({"id": i, "text": text, "soft": soft, "host": host, "domain": ".".join(host.split(".")[-2:]), "suffix": host.split(".")[-1], "code": pick(r"^[a-z]+://[^/]*/([a-z]{2})(?:/|$)", url), "declared": language.declared_language(page)})
    whole = sum(s["soft"] for s in seen)
    for s in seen:
        mass = lambda field: sum(o["soft"] for o in seen if o[field] == s[field])  # noqa: B023, E731
        logs_of = s["text"].copy()
        for field in ("declared", "suffix", "code"):
            values = len({o[field] for o in seen})
            logs_of += np.log((mass(field) + 0.5) / (whole + 0.5 * values))
        base = (whole - s["soft"] + 1) / ((whole - s["soft"]).sum() + len(names))
        domain = mass("domain") - s["soft"]
        prior = (domain + 10 * base) / (domain.sum() + 10)
        host = mass("host") - s["soft"]
        logs_of += np.log((host + 10 * prior) / (host.sum() + 10))
        posterior = np.exp(logs_of - np.logaddexp.reduce(logs_of))
        assert got[s["id"]].language == names[int(posterior.argmax())]
        assert got[s["id"]].confidence == pytest.approx(posterior.max(), abs=2e-6)
