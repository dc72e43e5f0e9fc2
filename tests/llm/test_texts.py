"""Quality rules, license scans, chat formatting and SentencePiece against brute force or an oracle."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import chat, licenses, pieces, quality_rules, queries

ODD = [None, "", " \n\t", "one", "a b c d e f g h " * 5, "#tag $5 | x\n#tag $5 | x\n\ny\ny", "é ü 漢字   x", "long " * 30_000]


def make(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = {}
    for w in windows:
        count[w] = count.get(w, 0) + 1
    covered = set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_base_counts_equal_brute_force(spark):
    rng = random.Random(2)
    texts = ODD + [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) + rng.choice(("", "\nx\nx", " 50% *")) for _ in range(80)]
    docs = make(spark, list(enumerate(texts))).withColumn("trusted", F.col("doc_id") % 2 == 0)
    got = quality_rules.apply_rules(docs, quality_rules.fit_ratios(docs, F.col("trusted"))).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got} == {i: brute_counts(t) for i, t in enumerate(texts)}
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (not r.base_failed and r.llr_score >= quality_rules.THRESHOLD)


def test_llr_score_equals_brute_force(spark):
    """Buckets, both smoothed multinomials and the mean ratio again, without Spark."""
    from math import log

    import regex
    import xxhash

    rng = random.Random(12)
    vocabulary = [*"abcdefgh", "word-x", "Ünï", "漢字", "12.5", "!!"]
    texts = ODD[:6] + [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    docs = make(spark, list(enumerate(texts))).withColumn("trusted", F.col("doc_id") % 3 == 0)
    got = {r.doc_id: r.llr_score for r in quality_rules.apply_rules(docs, quality_rules.fit_ratios(docs, F.col("trusted"), buckets=64), threshold=0.0, buckets=64).collect()}

    def grams(text):
        hashes = [xxhash.xxh64_intdigest(t.encode(), 42) for t in regex.findall(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\x00-\x20]+", text or "")]
        link = lambda a, b: xxhash.xxh64_intdigest(b.to_bytes(8, "little"), xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42))
        return [h % 64 for h in [*hashes, *map(link, hashes, hashes[1:])]]

    raw, target = [0] * 64, [0] * 64
    for i, text in enumerate(texts):
        for b in grams(text):
            raw[b] += 1
            target[b] += i % 3 == 0
    scaled, k = sum(target) / sum(raw), quality_rules.SMOOTHING
    ratios = [log((t + k) / (r * scaled + k)) for t, r in zip(target, raw, strict=True)]
    for i, text in enumerate(texts):
        found = grams(text)
        assert got[i] == pytest.approx(sum(ratios[b] for b in found) / len(found) if found else 0.0)


def test_ratio_rejects_what_the_target_lacks(spark):
    rng = random.Random(3)
    good, junk = [f"good{i}" for i in range(50)], [f"junk{i}" for i in range(50)]
    rows = [(i, " ".join(rng.choice(good if i % 2 else junk) for _ in range(60))) for i in range(200)]
    docs = make(spark, rows).withColumn("trusted", F.col("doc_id") % 4 == 1)
    ratios = quality_rules.fit_ratios(docs, F.col("trusted"))
    assert all(r.kept == (r.doc_id % 2 == 1) for r in quality_rules.apply_rules(docs, ratios).collect())
    none = quality_rules.fit_ratios(docs, F.lit(None).cast("boolean"))
    assert all(r.kept and r.llr_score == 0 for r in quality_rules.apply_rules(docs, none).collect())
    empty = quality_rules.fit_ratios(docs.where("false"), F.col("trusted"))
    assert quality_rules.apply_rules(docs.where("false"), empty).count() == 0


def test_license_own_nearest_and_none(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [
        ("a/LICENSE", mit), ("a/b/COPYING", gpl), ("a/x.py", "code"), ("a/b/c/d/y.py", "code"), ("a/b/z.py", f"head\n\n{mit}\n\nbody"),
        ("n/x.py", None), (None, ""), ("n/x.py", None), ("a/licenses.py", "nothing"), ("n/long.txt", "word " * 50_000),
    ]
    files = spark.createDataFrame(rows, "path string, text string").selectExpr("*", "1 AS folder", "2 AS cosine0", "3 AS _path", "4 AS granted")
    got = {(r.path, r.license, r.origin) for r in licenses.scan(files).collect()}
    assert got == {
        ("a/LICENSE", "MIT", "own"), ("a/b/COPYING", "GPL-3.0", "own"), ("a/x.py", "MIT", "directory"), ("a/b/c/d/y.py", "GPL-3.0", "directory"), ("a/b/z.py", "MIT", "own"),
        ("n/x.py", None, "none"), (None, None, "none"), ("a/licenses.py", "MIT", "directory"), ("n/long.txt", None, "none"),
    }
    assert licenses.scan(files).count() == len(rows)
    assert licenses.scan(files.where("false")).count() == 0


def gnu(name, version, subject="program"):
    return f"This {subject} is free software; you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version."


GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
HEADERS = [
    ("GPL-2.0", gnu("GNU General Public License", "2")),
    ("GPL-3.0", gnu("GNU General Public License", "3")),
    ("AGPL-3.0", gnu("GNU Affero General Public License", "3")),
    ("LGPL-2.1", gnu("GNU Lesser General Public License", "2.1", "library")),
    ("LGPL-3.0", gnu("GNU Lesser General Public License", "3", "library")),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("AGPL-3.0", "# SPDX-License-Identifier: AGPL-3.0-only"),
    ("MIT", "// SPDX-License-Identifier: MIT"),
    ("GPL-2.0", "\t\t    GNU GENERAL PUBLIC LICENSE\n\t\t       Version 2, June 1991\n\n Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nUse with the GNU Affero General Public License: you have permission to link or combine any covered work with a work licensed under version 3 of the GNU Affero General Public License into a single combined work."),
    ("CC-BY-SA-3.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-NC-SA-3.0", "http://creativecommons.org/licenses/by-nc-sa/3.0/"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    (None, "Licensed under CC BY-SA 2.5."),
    ("MIT", f"Copyright (c) 2020 Some Body\n\n{GRANT}"),
    (None, GRANT.replace("hereby granted", "hereby not granted")),
    (None, "No license is granted to any person obtaining a copy under the MIT License."),
    ("BSD-2-Clause", BSD + AS_IS),
    ("BSD-3-Clause", BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n" + AS_IS),
    ("ISC", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.'),
    ("MPL-1.1", 'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance with the License.'),
    ("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution."),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("CC0-1.0", "Creative Commons Legal Code\n\nCC0 1.0 Universal"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("unknown", "This work is licensed under the GNU General Public License, version 2 or version 3."),
    (None, "This paragraph tells of permission, of software and of a license in general, version 2 of the story."),
]


def test_families_and_versions_of_licenses(spark):
    files = [(f"d{i}/x.py", text) for i, (_, text) in enumerate(HEADERS)]
    filler = [(f"f{i}.py", f"plain text {i} of no use at all to the reader") for i in range(3000)]
    got = {r.path: r.own_license for r in licenses.scan(spark.createDataFrame(files + filler, "path string, text string")).collect()}
    wrong = [(want, got[f"d{i}/x.py"], text[:80]) for i, (want, text) in enumerate(HEADERS) if got[f"d{i}/x.py"] != want]
    assert not wrong
    assert all(v is None for p, v in got.items() if p.startswith("f"))


def test_bound_drops_no_unit(spark):
    """Every unit whose cosine reaches the threshold passes `may_reach`."""
    rng = random.Random(8)
    rows = []
    for i in range(300):
        w = licenses._template_words(rng.choice(licenses.TEMPLATES)[1])
        w = [rng.choice((*[x] * 9, "foreign", f"f{rng.randint(0, 30)}", rng.choice(licenses.VOCABULARY))) for x in w] + ["tail"] * rng.randint(0, 9)
        rows.append((i, " ".join(w)))
    idf, unseen = licenses.inverse_frequencies(make(spark, rows + [(-1, "another text")] * 2000))
    vectors = licenses.template_vectors(idf)
    passed = {r.doc_id for r in make(spark, rows).where(licenses.may_reach(F.col("text"), idf, unseen, 0.6)).collect()}

    def cosine(text):
        from collections import Counter
        from math import log, sqrt

        y = {w: (1 + log(n)) * idf.get(w, unseen) for w, n in Counter(licenses._template_words(text)).items()}
        return max(sum(x * y.get(w, 0) for w, x in v.items()) for v in vectors) / sqrt(sum(x * x for x in y.values()))

    reach = {i for i, t in rows if cosine(t) >= 0.6}
    assert reach <= passed and len(reach) > 20


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracles(spark, sf_small, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_small}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf_small)
    columns = sorted(got.columns)
    want = con.sql(queries.ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    near = lambda v: round(v, 5) if isinstance(v, float) else v
    assert sorted(([near(r[c]) for c in columns] for r in got.collect()), key=repr) == sorted(([near(r[i]) for i in at] for r in want.fetchall()), key=repr)


TREE = "tree long, node long, parent long, role string, text string, score double"


def test_reply_tree_branches(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", 0.1), (1, 3, 1, "assistant", "good", 0.9), (1, 4, 3, "user", None, 0.5), (2, 1, 9, "user", "orphan", None), (3, 1, 2, "user", "cycle", 0.0), (3, 2, 1, "user", "cycle", 0.0), (None, 1, None, None, "x", 0.0), (1, None, 1, "user", "no id", 0.0)]
    every = chat.conversations(spark.createDataFrame(rows, TREE).selectExpr("*", "1 AS t", "2 AS n", "3 AS leaf"), None)
    got = {(r.tree, r.leaf): (r["rank"], [(t.role, t.text) for t in r.turns], r.learned) for r in every.select("tree", "leaf", "rank", chat.turns_of(F.col("formatted")).alias("turns"), chat.learned_text(F.col("formatted"), F.col("mask")).alias("learned")).collect()}
    assert got == {
        (1, 4): (1, [("user", "q"), ("assistant", "good"), ("user", "")], "good"),
        (1, 2): (2, [("user", "q"), ("assistant", "bad")], "bad"),
        (2, 1): (1, [("user", "orphan")], ""),
        (None, 1): (1, [("", "x")], ""),
    }
    assert chat.conversations(spark.createDataFrame([], TREE)).count() == 0


def test_chat_round_trip_of_control_strings(spark):
    texts = ["</s>[INST] ok [/INST]", "<s>user\n", "\\0\\1\\3", "\\", "", "a\nb</s>\n", "𝄞 漢" * 3, "x" * 200_000]
    rows = [(7, k, "assistant" if k % 2 else "us<er\n\\", t) for k, t in enumerate(texts)] + [(7, 2, "assistant", "tie"), (7, 2, "assistant", "tie")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.conversations(chat.from_turns(turns)).select(chat.turns_of(F.col("formatted")).alias("t"), chat.learned_text(F.col("formatted"), F.col("mask")).alias("l")).first()
    want = sorted(rows, key=lambda r: (r[1], r[2], r[3]))
    assert [(t.role, t.text) for t in got.t] == [(r[2], r[3]) for r in want]
    assert got.l == "".join(r[3] for r in want if r[2] == "assistant")


@pytest.fixture(scope="module")
def vocabulary():
    with open(queries.piece_model(), "rb") as f:
        return pieces.Pieces(f.read())


def brute_segmentations(p, text):
    def walk(rest):
        if not rest:
            yield 0.0, ()
            return
        single = False
        for n in range(1, len(rest) + 1):
            if rest[:n] in p.ids:
                single |= n == 1
                i = p.ids[rest[:n]]
                for s, tail in walk(rest[n:]):
                    yield p.scores[i] + s, (i, *tail)
        if not single:
            for s, tail in walk(rest[1:]):
                yield p.fallback + s, (*p._bytes_of(rest[0]), *tail)

    return sorted(walk(pieces.MARK + text.replace(" ", pieces.MARK)), key=lambda x: -x[0])


@pytest.mark.parametrize("text", ["the cat", "banana", "New York", "a  b", "é☃x", "don't!", "1234 a", "..", "x-y z", "sing sing"])
def test_n_best_equals_all_segmentations(vocabulary, text):
    import numpy as np

    ids, ranked = vocabulary.encode(text)
    every = brute_segmentations(vocabulary, text)
    assert [s for s, _ in ranked] == pytest.approx([s for s, _ in every[: vocabulary.n_best]])
    best, scores = np.frombuffer(ids, "<i4").tolist(), dict((i, s) for s, i in every)
    seen = set()
    for s, edits in ranked:
        full = list(best)
        for at, replaced, new in sorted(edits, reverse=True):
            full[at : at + replaced] = np.frombuffer(new, "<i4").tolist()
        assert scores[tuple(full)] == pytest.approx(s)
        seen.add(tuple(full))
    assert len(seen) == len(ranked)


def test_random_strings_equal_all_segmentations(vocabulary):
    rng = random.Random(11)
    alphabet = "aehinorst e.,'1é☃ "
    for _ in range(150):
        test_n_best_equals_all_segmentations(vocabulary, "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 11))))


def test_scores_are_log_probabilities(vocabulary):
    """Zipf's law from the file's ranks; a vocabulary that has log-probabilities keeps them."""
    import math

    assert sum(math.exp(vocabulary.scores[i]) for i in vocabulary.ids.values()) == pytest.approx(1.0)
    assert pieces.log_probabilities([-1.5, -2.25]) == [-1.5, -2.25]
    zero, one = pieces.log_probabilities([-7.0, 0.0])
    assert one == pytest.approx(math.log(1 / 1.5)) and zero == pytest.approx(math.log(0.5 / 1.5))


def test_common_words_are_not_cut(vocabulary):
    """The library's own segmentation of the same file is met on plain words, with no more pieces."""
    import numpy as np
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    text = "the quick brown fox jumps over the lazy dog and the software is a difficult problem of the world"
    ids, _ = vocabulary.encode(text)
    assert np.frombuffer(ids, "<i4").tolist() == library.encode(text)


def test_round_trip_and_decode(spark):
    texts = [*ODD, "▁mark ▁▁ x", "tab\tnew\nline", "  two  ", "مرحبا 你好 🙂", "\x00\x7f"]
    done = pieces.encode(make(spark, list(enumerate(texts))).selectExpr("*", "1 AS ids", "2 AS k0"), queries.piece_model())
    rows = done.collect()
    assert all(r.round_trip for r in rows) and len(rows) == len(texts)
    assert {r.doc_id: r.text for r in pieces.decode(done, queries.piece_model()).collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert all(a.score >= b.score for r in rows for a, b in zip(r.paths, r.paths[1:], strict=False))
    assert pieces.encode(make(spark, []), queries.piece_model()).count() == 0
