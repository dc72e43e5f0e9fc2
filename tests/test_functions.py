from pyspark.sql import functions as F

from tallyloom.functions import answers, numbers, text
from tallyloom.operators import markdown, quality
from tallyloom.sources import banks


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_text(spark):
    v = lambda c: value(spark, c)
    assert v(text.truncate(F.lit("hello world"), 5)) == "hello…" and v(text.truncate(F.lit("hello"), 5)) == "hello"
    assert v(text.strip_markdown(F.lit("a * b"))) == "a * b"
    assert v(text.strip_markdown(F.lit("**a** *b* `c` [d](e)\nf"))) == "a b c d f"
    assert v(text.render_explanation(F.lit("**a** <b>\n"))) == "<strong>a</strong> &lt;b&gt;<br>"
    assert v(text.plain_ruby(F.lit("<ruby>中<rp>(</rp><rt>中</rt><rp>)</rp></ruby><ruby>日<rp>(</rp><rt>ひ</rt><rp>)</rp></ruby>"))) == "中<ruby>日<rp>(</rp><rt>ひ</rt><rp>)</rp></ruby>"
    assert v(text.headings_with_ids(F.lit("<h2>A b</h2>x<h3>C</h3>"))) == '<h2 id="a-b">A b</h2>x<h3 id="c">C</h3>'
    assert v(text.clean_stem(F.lit("[来源：a.md] 题干（ C ）  x D"))) == "题干 x"
    assert v(text.explicit_tags(F.lit("x\n**标签**：a·b、 c\ny"))) == ["a", "b", "c"]
    assert [v(text.chinese_number(F.lit(x))) for x in ("一", "十", "十二", "x")] == [1, 10, 12, None]
    assert v(text.normalize_sections(F.lit("  a **考点** b\n\n\n\n**标签** c "))) == "a\n\n**考点** b\n\n**标签** c"
    assert [v(text.labelled_answer(F.lit(x))) for x in ("**答案**：X", "**答案：X**", "no")] == ["X", "X", None]
    assert v(text.highlight(F.lit("a.b A.B"), "a.b")) == "<mark>a.b</mark> <mark>A.B</mark>"
    assert v(text.already_enriched(F.lit("> **考点：** x"))) and not v(text.already_enriched(F.lit("**考点**：x")))


def test_letters(spark):
    v = lambda c: value(spark, c)
    assert v(answers.toggle_letter(F.lit("ABC"), F.lit("B"))) == "AC" and v(answers.toggle_letter(F.lit("B"), F.lit("A"))) == "AB"
    assert [v(answers.same_letters(F.lit(a), F.lit("ABC"))) for a in ("CAB", "AB", "ABCD")] == [True, False, False]


def test_detect_variants(spark):
    options = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(t).alias("text")) for k, t in (("A", "毛泽东"), ("B", "周恩来"))])
    kind = lambda raw, variant, o=options: tuple(value(spark, answers.detect_answer(F.lit(raw), o, variant=variant)))
    assert kind("周恩来。", "party") == ("single", "B")
    assert kind("毛泽东和周恩来", "military") == ("multi", "AB")
    assert kind("错误（实质）", "military") == ("judgement", "错误")
    assert kind("自由", "military", F.array().cast("array<struct<key:string,text:string>>")) == ("fill", "自由")
    assert kind("BA", "history") == ("multi", "AB") and kind("自由", "history") == ("skip", "")


def test_options(spark):
    assert value(spark, answers.split_options(F.lit("A、x B、y C、z"))) == ["A、x", "B、y", "C、z"]
    assert value(spark, answers.split_options(F.lit("A、x"))) is None
    row = value(spark, answers.parse_word_option(F.lit("- A. かな【音】 ✅")))
    assert (row.key, row.text, row.correct, row.annotation) == ("A", "かな", True, "音")


def test_numbers(spark):
    assert value(spark, numbers.percent(F.lit(1), F.lit(8))) == 13 and value(spark, numbers.percent(F.lit(1), F.lit(0))) == 0
    assert value(spark, numbers.clock(F.lit(125))) == "02:05"
    assert [value(spark, numbers.activity_level(F.lit(n))) for n in (0, 1, 6, 16)] == [0, 1, 2, 3]


def test_parse_judgement_and_rejects(spark):
    source = "## 第一套\n### 1. 题（ A ）\nA. 正确\nB. 错误\n**答案**：B\n因为\n> ### 2. 多选\n> A. a\n> B. b\n> C. c\n> **答案**：CA\n### 3. 坏\n**答案**：？"
    lines = markdown.lines_of(spark.createDataFrame([("f", source)], "file string, text string"))
    found = markdown.typed_questions(markdown.blocks(lines, "^###\\s+\\d+\\."), "^###\\s+\\d+\\.\\s*(.*)$")
    rows = {r.block: r for r in found.collect()}
    assert (rows[1].kind, rows[1].answer_key, rows[1].answer_text, rows[1].explanation, rows[1].stem) == ("judgement", "B", "错误", "因为", "题")
    assert (rows[2].kind, rows[2].answer_key, rows[2].answer_text) == ("multi", "AC", "a / c")
    assert [r.reason for r in markdown.rejected(found).collect()] == ["unrecognized-answer"]


def test_passage_and_words(spark):
    source = "**文章：**\np1\n### 第1题\n### 第2题\n### 文章（二）\np2\n---\n### 第3题\n## new\n### 第4题"
    lines = markdown.lines_of(spark.createDataFrame([("f", source)], "file string, text string"))
    assert {r.number: r.passage for r in markdown.passages(lines).collect()} == {1: "p1", 2: "p1", 3: "p2", 4: None}
    words = "## 第3课\n### 1. 学校（がっこう） — school\n**a** x\n- A. がくこう\n- B. がっこう ✅\n**b** y\n- A. 校学\n- B. 学校 ✅"
    rows = markdown.word_entries(markdown.lines_of(spark.createDataFrame([("f", words)], "file string, text string"))).orderBy("sub").collect()
    assert [(r.lesson, r.entry, r.kanji, r.kana, r.translation, len(r.options), r.answer) for r in rows] == [(3, 1, "学校", "がっこう", "school", 2, "B")] * 2


def test_rewrite(spark):
    source = "## s\n### 4. a\nx\n### 9. b\ny"
    blocks = markdown.blocks(markdown.lines_of(spark.createDataFrame([("f", source)], "file string, text string")), "^###\\s+\\d+\\.")
    assert markdown.rewritten(blocks).first().text == "### 1. a\nx\n### 2. b\ny"


def test_bank_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", None, "s"), ("b", "x", "t")], "id string, category string, stem string")
    rows.where("id = 'b'").coalesce(1).write.json(str(tmp_path / "bank"))
    assert {r.id: r.category for r in banks.read_bank(spark, str(tmp_path / "bank"), "history", "json").collect()}["b"] == "x"
    banks.write_bank(rows.fillna("history", ["category"]), str(tmp_path / "out"), "parquet")
    assert spark.read.parquet(str(tmp_path / "out")).where("category = 'history'").count() == 1


def test_unusable_options_and_audit(spark):
    options = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(t).alias("text")) for k, t in zip("ABCDE", "x国军政人", strict=True)])
    assert value(spark, answers.unusable_template(options, {"B": "国", "C": "军"}))
    report = quality.audit(spark.createDataFrame([(1, "")], "id int, stem string"), {"no_stem": F.col("stem") == ""})
    assert report.first().failures == 1


def test_norm_audit_is_the_two_patterns(spark):
    """One pass over characters takes out what the two patterns take out, for every character of the basic plane and some above; and texts are read once."""
    signs = [chr(c) for c in [*range(1, 0xD800), *range(0xE000, 0x10000), 0x1F600, 0x20000, 0x1D400]]
    texts = ["".join(signs[k : k + 97]) for k in range(0, len(signs), 97)] + ["", None, "a \\ b[c]", " A\tB\u3000C， d"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.lower(F.regexp_replace(F.regexp_replace(F.coalesce("t", F.lit("")), text.SPACE, ""), text.SIGNS_AUDIT, ""))
    assert frame.where(~text.norm_audit(F.col("t")).eqNullSafe(plain)).count() == 0
    bank = frame.select(F.monotonically_increasing_id().alias("id"), F.col("t").alias("stem"), F.lit("a").alias("group_id")).withColumn("position", F.col("id"))
    plan = quality.agreeing_dedup(bank, F.col("group_id"), F.length("stem"), columns=["id"])._jdf.queryExecution().optimizedPlan().toString()  # noqa: SLF001
    assert "md5" not in plan and "translate" not in plan
