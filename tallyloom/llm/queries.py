"""Registered queries of the training-data operators: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import chat, decontaminate, hard_negatives, hash_index, language, licenses, line_dedup, pieces, quality_model, quality_rules, simhash, toxicity, vector_codes
from tallyloom.llm.common import BLANK_RUN, BROADCAST_BYTES, checked_broadcast, table


def with_trust(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, text, trusted) of `docs`: whether `labels` marks the document as of good quality.

    Ids are broadcast up to four times the usual bound, as the other side of a shuffled join is all texts.
    """
    good = table(spark, sf_dir, "labels").where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("good_id")).distinct()
    return docs.select("doc_id", "text").join(checked_broadcast(good, 4 * BROADCAST_BYTES), F.col("doc_id") == F.col("good_id"), "left").select("doc_id", "text", F.col("good_id").isNotNull().alias("trusted"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ratios = quality_rules.fit_ratios(with_trust(spark, docs, sf_dir), F.col("trusted"))
    return quality_rules.apply_rules(docs, ratios)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = decontaminate.flag(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return flagged.select("doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce("items", F.array().cast("array<bigint>")).alias("items"), "overlap", "matches")


def piece_model() -> str:
    """Vocabulary file of the production runs; an installed package carries it."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = pieces.encode(table(spark, sf_dir, "documents"), piece_model())
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), F.transform("paths", lambda p: p["score"]).alias("scores"), "round_trip")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files in source/lang/thousand/hundred.

    A short text about a licence is named a licence file and lies one to four folders deep, by its id.
    """
    short = (F.size(F.split("text", BLANK_RUN)) <= 40) & F.col("text").ilike("%licen%")
    folders = F.array(F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("xx")), *[F.floor(F.col("doc_id") / n).cast("string") for n in (1000, 100)])
    depth = F.when(short, F.pmod("doc_id", F.lit(4)) + 1).otherwise(4).cast("int")
    name = F.concat(F.when(short, "LICENSE-").otherwise(""), F.col("doc_id").cast("string"), F.lit(".txt"))
    path = F.concat_ws("/", F.slice(folders, F.lit(1), depth), name)
    files = table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text")
    return licenses.scan(files).select("doc_id", "path", "own_license", "cosine", "license", "origin")


def _op3_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({k}, {quoted(name)}, {quoted(text)})" for k, (name, text) in enumerate(licenses.TEMPLATES))
    marks = ", ".join(f"({quoted(w)}, {licenses.mask_of((w,))}::BIGINT)" for w in licenses.MARK_WORDS)
    told = ", ".join(f"({quoted(code)}, [{', '.join(f'{licenses.mask_of(g)}::BIGINT' for g in groups)}], {licenses.mask_of(none)}::BIGINT)" for code, (groups, none) in licenses.MARKS.items())
    return f"""
WITH templates(template, license, text) AS (VALUES {values}),
mark_words(word, mark) AS (VALUES {marks}),
told(license, groups, others) AS (VALUES {told}),
short AS (SELECT *, len(string_split_regex(text, '[\x20\x09-\x0D]+')) <= 40 AND text ILIKE '%licen%' AS is_notice FROM documents),
files AS (
  SELECT doc_id, text, array_to_string([coalesce(source, 'unknown'), coalesce(lang, 'xx'), (doc_id // 1000)::VARCHAR, (doc_id // 100)::VARCHAR][1:CASE WHEN is_notice THEN doc_id % 4 + 1 ELSE 4 END], '/')
    || '/' || CASE WHEN is_notice THEN 'LICENSE-' ELSE '' END || doc_id || '.txt' AS path,
    CASE WHEN regexp_matches(text, {quoted(licenses.REFUSAL)}) THEN array_to_string([p FOR p IN string_split_regex(text, '\n{{2,}}') IF NOT regexp_matches(p, {quoted(licenses.REFUSAL)})], chr(10) || chr(10)) ELSE text END AS said
  FROM short
),
tw AS (
  SELECT template, license, word, 1 + ln(count(*)) AS tf FROM (SELECT template, license, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS word FROM templates)
  WHERE word <> '' GROUP BY ALL
),
total AS (SELECT count(*) AS n FROM documents),
df AS (
  SELECT word, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct(string_split_regex(lower(text), '[^a-z0-9]+'))) AS word FROM documents)
  WHERE word IN (SELECT word FROM tw) GROUP BY word
),
idf AS (SELECT w.word, ln((n + 1) / (coalesce(df, 0) + 1)) + 1 AS idf FROM (SELECT DISTINCT word FROM tw) w LEFT JOIN df USING (word), total),
tv AS (SELECT template, license, word, tf * idf / sqrt(sum(tf * tf * idf * idf) OVER (PARTITION BY template)) AS x FROM tw JOIN idf USING (word)),
units AS (
  SELECT path, -1 AS kind, 0 AS u, said AS unit FROM files
  UNION ALL SELECT path, 0, unnest(range(1, len(p) + 1)), unnest(p) FROM (SELECT path, string_split(said, chr(10)) AS p FROM files)
  UNION ALL SELECT path, 1, unnest(range(1, len(p) + 1)), unnest(p) FROM (SELECT path, string_split_regex(said, '\n{{2,}}') AS p FROM files)
),
terms AS (SELECT path, kind, u, word, count(*) AS n FROM (SELECT path, kind, u, unnest(string_split_regex(lower(unit), '[^a-z0-9]+')) AS word FROM units) WHERE word <> '' GROUP BY ALL),
weighed AS (SELECT path, kind, u, terms.word, coalesce(mark, 0) AS mark, (1 + ln(terms.n)) * coalesce(idf, ln(total.n + 1) + 1) AS y FROM terms LEFT JOIN idf USING (word) LEFT JOIN mark_words USING (word), total),
norms AS (SELECT path, kind, u, sqrt(sum(y * y)) AS norm, bit_or(mark) AS marks FROM weighed GROUP BY ALL),
dots AS (SELECT path, kind, u, template, license, sum(x * y) AS dot FROM weighed JOIN tv USING (word) GROUP BY ALL),
best AS (
  SELECT path, kind, u, license, max(round(dot / norm, 6)) AS cosine FROM dots JOIN norms USING (path, kind, u) JOIN told USING (license)
  WHERE round(dot / norm, 6) >= {licenses.THRESHOLD} AND (marks & others) = 0 AND len([g FOR g IN groups IF (marks & g) = 0]) = 0 GROUP BY ALL
),
ordered AS (SELECT path, license, cosine, row_number() OVER o AS k, lead(cosine) OVER o AS next FROM best WINDOW o AS (PARTITION BY path, kind, u ORDER BY cosine DESC, license)),
judged AS (SELECT path, CASE WHEN cosine - coalesce(next, 0) >= {licenses.MARGIN} THEN license ELSE '{licenses.UNKNOWN}' END AS license, cosine FROM ordered WHERE k = 1),
own AS (SELECT path, license, cosine FROM judged QUALIFY row_number() OVER (PARTITION BY path ORDER BY license = '{licenses.UNKNOWN}', cosine DESC, license) = 1),
granted AS (
  SELECT regexp_replace(path, '/[^/]*$', '') AS above, license FROM own WHERE license <> '{licenses.UNKNOWN}' AND regexp_matches(path, '(?i)/(un)?(licen[sc]e|copying|notice)([.-][^/]*)?$')
  QUALIFY row_number() OVER (PARTITION BY above ORDER BY cosine DESC, license) = 1
),
folders AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS folder FROM files),
steps AS (SELECT folder, d, array_to_string(string_split(folder, '/')[1:d], '/') AS above FROM folders, LATERAL (SELECT unnest(range(1, len(string_split(folder, '/')) + 1)) AS d)),
nearest AS (SELECT folder, arg_max(license, d) AS license FROM steps JOIN granted USING (above) GROUP BY folder)
SELECT f.doc_id, f.path, o.license AS own_license, o.cosine, coalesce(o.license, g.license) AS license,
  CASE WHEN o.license IS NOT NULL THEN 'own' WHEN g.license IS NOT NULL THEN 'directory' ELSE 'none' END AS origin
FROM files f LEFT JOIN own o USING (path) LEFT JOIN nearest g ON g.folder = regexp_replace(f.path, '/[^/]*$', '')
"""


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = toxicity.held_out(F.col("doc_id"))
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held)
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", F.size("dropped_lines").cast("long").alias("n_dropped"), F.array_join(F.col("dropped_lines").cast("array<string>"), ",").alias("dropped"), F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


OP6_SQL = """
WITH parts AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id NULLS FIRST, text) AS r, string_split(text, chr(10)) AS p FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)),
occ AS (
  SELECT r, i - 1 AS line_no, r::HUGEINT * 2147483648 + i - 1 AS place, trim(p[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line
  FROM parts, LATERAL (SELECT unnest(range(1, len(p) + 1)) AS i)
),
named AS (SELECT * FROM occ WHERE line <> ''),
firsts AS (SELECT line, min(place) AS first FROM named GROUP BY line),
split AS (SELECT line, first, string_split_regex(line, '[\x20\x09-\x0D]+') AS w FROM firsts),
long AS (SELECT * FROM split WHERE len(w) >= 5),
variants AS (
  SELECT line, first, i AS place, len(w) - 1 AS n, array_to_string(list_concat(w[1:i - 1], w[i + 1:]), ' ') AS v FROM long, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i)
  UNION ALL SELECT line, first, 0, len(w), array_to_string(w, ' ') FROM long
),
replaced AS (SELECT v, n, place, min(first) AS least FROM variants GROUP BY v, n, place),
sides AS (SELECT v, n, min(CASE WHEN place = 0 THEN least END) AS short, min(CASE WHEN place > 0 THEN least END) AS long FROM replaced WHERE n >= 5 GROUP BY v, n),
near AS (
  SELECT x.line FROM variants x JOIN replaced r ON x.v = r.v AND x.n = r.n AND x.place = r.place WHERE x.first > r.least
  UNION
  SELECT x.line FROM variants x JOIN sides s ON x.v = s.v AND x.n = s.n WHERE x.first > CASE WHEN x.place = 0 THEN s.long ELSE s.short END
),
gone AS (
  SELECT DISTINCT n.r, n.line_no FROM named n JOIN firsts f ON n.line = f.line WHERE n.place <> f.first OR n.line IN (SELECT line FROM near)
),
flagged AS (
  SELECT o.r, o.line_no, p.p[o.line_no + 1] AS line, g.line_no IS NOT NULL AS out
  FROM occ o JOIN parts p ON o.r = p.r LEFT JOIN gone g ON g.r = o.r AND g.line_no = o.line_no
),
kept AS (
  SELECT r, count(*) FILTER (out) AS n_dropped, coalesce(string_agg(line_no::VARCHAR, ',' ORDER BY line_no) FILTER (out), '') AS dropped,
    coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT out), '') AS kept
  FROM flagged GROUP BY r
)
SELECT d.doc_id, coalesce(n_dropped, 0) AS n_dropped, coalesce(dropped, '') AS dropped, length(kept) AS kept_chars, sha256(kept) AS kept_sha256
FROM documents d LEFT JOIN parts p ON d.doc_id IS NOT DISTINCT FROM p.doc_id AND d.text = p.text LEFT JOIN kept USING (r)
"""


TRICKY = "</s>[INST] ok [/INST]"


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY).alias("text"))
    done = chat.conversations(chat.from_turns(turns.unionByName(extra)))
    read = done.select("tree", "formatted", chat.turns_of(F.col("formatted")).alias("turns"), chat.learned_text(F.col("formatted"), F.col("mask")).alias("learned"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP7_SQL = """
WITH all_turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), t AS (
  SELECT *, length(role) + length(replace(replace(text, chr(92), '..'), '<', '..')) + 9 AS chars FROM all_turns
), c AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn) AS said,
    coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '') AS learned, sum(chars) AS formatted_chars
  FROM t GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars FROM c
"""


def op8_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = quality_model.held_out(F.col("doc_id"))
    model = quality_model.fit(docs, table(spark, sf_dir, "labels"), ~held)
    return quality_model.score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


FINITE_SQL = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _op11_sql() -> str:
    """Rounds of plain nearest entries, one pair of steps for each."""
    parts, entries, rounds = vector_codes.PARTS, vector_codes.ENTRIES, vector_codes.ROUNDS
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""far{r} AS (SELECT r, p, k, sum((x - c) * (x - c))::HUGEINT AS d FROM components JOIN book{r} USING (p, pos) GROUP BY ALL),
near{r} AS MATERIALIZED (SELECT r, p, min(d * {entries} + k) % {entries} AS k, min(d) AS d FROM far{r} GROUP BY ALL)""")
        if r < rounds:
            steps.append(f"""sums{r} AS (SELECT p, k, pos, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM components JOIN near{r} USING (r, p) GROUP BY ALL),
book{r + 1} AS MATERIALIZED (SELECT p, k, pos, CASE WHEN n IS NULL THEN c ELSE (s - (s % n + n) % n) // n END AS c FROM book{r} LEFT JOIN sums{r} USING (p, k, pos))""")
    return f"""
WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS r, vec_id, label, embedding FROM embeddings WHERE {FINITE_SQL}),
wide AS (SELECT max(len(embedding)) // {parts} AS w FROM kept),
components AS MATERIALIZED (
  SELECT r, (i - 1) // w AS p, (i - 1) % w AS pos, floor({vector_codes.SCALE} * embedding[i]::DOUBLE)::HUGEINT AS x FROM kept, wide, LATERAL (SELECT unnest(range(1, {parts} * w + 1)) AS i)
),
book0 AS MATERIALIZED (SELECT p, r AS k, pos, x AS c FROM components WHERE r < {entries}),
{", ".join(steps)},
coded AS (SELECT r, string_agg(printf('%02x', k::INTEGER), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near{rounds} GROUP BY r)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, k, pos)) FROM book{rounds}) AS codebooks_sha256
FROM kept JOIN coded USING (r)
"""


def op12_hash_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return hash_index.search(hash_index.build(vectors, 10), vectors.where("vec_id % 100 = 0"), 10).select("query_id", "rank", "vec_id", "score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return hard_negatives.mine(vectors, "vec_id % 100 = 0").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


OP13_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL AND {FINITE_SQL}
),
scored AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, a.label AS own, c.vec_id, c.label, list_dot_product(a.v, c.v)::BIGINT AS score FROM kept a JOIN kept c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0
),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE own = label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER w AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id) WHERE own <> label AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 10
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_licenses": op3_licenses,
    "op4_language": op4_language,
    "op5_toxicity": op5_toxicity,
    "op6_line_dedup": op6_line_dedup,
    "op7_chat": op7_chat,
    "op8_quality_model": op8_quality_model,
    "op9_simhash": op9_simhash,
    "op10_quality_rules": op10_quality_rules,
    "op11_vector_codes": op11_vector_codes,
    "op12_hash_index": op12_hash_index,
    "op13_hard_negatives": op13_hard_negatives,
}
ORACLE_SQL: dict[str, str] = {"op3_licenses": _op3_sql(), "op6_line_dedup": OP6_SQL, "op7_chat": OP7_SQL, "op11_vector_codes": _op11_sql(), "op13_hard_negatives": OP13_SQL}
