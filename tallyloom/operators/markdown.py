"""Markdown question files to rows: lines, running context, blocks, typed questions.

A file is the unit: its lines are numbered inside it, and every window runs within one file. The
recipe is the same for all formats: number the lines, classify them, carry the last header forward,
number the blocks by counting their headers, and gather each block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.functions import answers
from tallyloom.functions.text import chinese_number, clean_stem, labelled_answer


def line_breaks(text: str) -> Column:
    """The text with one kind of line break."""
    return F.regexp_replace(text, "\r\n?", "\n")


def unquoted(raw: str) -> Column:
    """The line without the quote mark of a block quote and blanks at its ends."""
    return F.trim(F.regexp_replace(raw, "^>\\s?", ""))


def lines_of(files: DataFrame, name: str = "file", text: str = "text") -> DataFrame:
    """(file, line_no, line): quote marks of block quotes are taken off."""
    split = files.select(F.col(name).alias("file"), F.posexplode(F.split(line_breaks(text), "\n")).alias("line_no", "raw"))
    return split.select("file", "line_no", unquoted("raw").alias("line"), "raw")


def running(value: Column, order: str = "line_no", *within: str) -> Column:
    """The last value that is not null, up to this row."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*within or ("file",)).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def extract(line: Column, pattern: str, group: int = 1) -> Column:
    """A group of the pattern, null where it does not match."""
    return F.when(line.rlike(pattern), F.regexp_extract(line, pattern, group))


def blocks(lines: DataFrame, header: str, section: str = "^##\\s+(.+)$") -> DataFrame:
    """(file, section, block, header, body): a block runs from a header line to the next header or section."""
    line = F.col("line")
    marked = lines.withColumn("section", running(extract(line, section))).withColumn("starts", line.rlike(header))
    ends = marked.withColumn("edge", F.col("starts") | line.rlike(section))
    order = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    numbered = ends.withColumn("part", F.sum(F.col("edge").cast("int")).over(order)).withColumn("block", F.sum(F.col("starts").cast("int")).over(order))
    inside = numbered.withColumn("in_block", F.max(F.when(F.col("starts"), F.col("part"))).over(order) == F.col("part"))
    gathered = inside.where("in_block").groupBy("file", "section", "block").agg(F.max(F.when(F.col("starts"), line)).alias("header"), F.array_sort(F.collect_list(F.when(~F.col("starts"), F.struct("line_no", "line", "raw")))).alias("rows"))
    return gathered.select("file", "section", "block", "header", F.transform("rows", lambda r: r["line"]).alias("body"), F.transform("rows", lambda r: r["raw"]).alias("raw_body"))


def typed_questions(found: DataFrame, title: str, variant: str = "history") -> DataFrame:
    """Questions of blocks: stem, options, kind, answer_key, answer_text, explanation.

    `title` is the header's pattern with the stem as its first group. Option lines, and lines with several
    options, count until the answer line; what follows it is the explanation. Blocks without a usable
    answer get kind `skip`, so that `rejected` can list them.
    """
    body = F.col("body")
    answered = F.filter(F.transform(body, lambda x: labelled_answer(x)), lambda x: x.isNotNull())
    at = F.coalesce(F.array_position(F.transform(body, lambda x: labelled_answer(x).isNotNull()), True), F.lit(0))
    before = F.when(at > 0, F.slice(body, F.lit(1), (at - 1).cast("int"))).otherwise(body)
    after = F.when(at > 0, F.slice(body, (at + 1).cast("int"), F.size(body))).otherwise(F.array().cast("array<string>"))
    pieces = F.flatten(F.transform(before, lambda x: F.coalesce(answers.split_options(x), F.array(x))))
    options = F.array_compact(F.transform(pieces, lambda x: answers.parse_option(x)))
    more = F.filter(before, lambda x: answers.parse_option(x).isNull() & (x != "") & ~x.rlike("^---+$"))
    stem = clean_stem(F.concat_ws("\n", F.regexp_extract("header", title, 1), F.array_join(more, "\n")))
    rows = found.select("file", "section", "block", stem.alias("stem"), options.alias("options"), F.get(answered, F.lit(0)).alias("answer"), F.trim(F.array_join(after, "\n")).alias("explanation"))
    kind = answers.detect_answer(F.coalesce("answer", F.lit("")), F.col("options"), variant=variant)
    judged = answers.is_judgement_options(F.col("options")) & F.upper(F.trim("answer")).rlike("^[AB]$")
    chosen = F.get(F.filter("options", lambda o: o["key"] == F.upper(F.trim(F.col("answer")))), F.lit(0))["text"]
    typed = rows.withColumn("typed", F.when(judged, F.struct(F.lit("judgement").alias("kind"), chosen.alias("normalized"))).otherwise(kind))
    kind, normalized = F.col("typed.kind"), F.col("typed.normalized")
    missing = ~kind.isin("judgement", "fill") & (F.size("options") == 0)
    unknown = (kind == "multi") & ~F.forall(F.filter(F.split(normalized, ""), lambda c: c != ""), lambda c: F.exists("options", lambda o: o["key"] == c))
    final_kind = F.when(missing | unknown | ((F.col("stem") == "") & (F.size("options") == 0)), "skip").otherwise(kind)
    key = F.when(kind == "judgement", F.when(normalized == answers.RIGHT, "A").otherwise("B")).when(kind == "fill", "FILL").otherwise(normalized)
    text = F.when(kind.isin("judgement", "fill"), normalized).otherwise(answers.answer_text(F.col("options"), normalized))
    shown = F.when(kind == "judgement", answers.judgement_options()).otherwise(F.col("options"))
    number = F.row_number().over(Window.partitionBy("file", "section", F.col("kind") == "skip").orderBy("block")).cast("bigint")
    out = typed.select("file", "section", "block", "stem", shown.alias("options"), final_kind.alias("kind"), key.alias("answer_key"), text.alias("answer_text"), "explanation")
    return out.withColumn("number", number)


def accepted(typed: DataFrame) -> DataFrame:
    return typed.where("kind <> 'skip'")


def rejected(typed: DataFrame) -> DataFrame:
    return typed.where("kind = 'skip'").withColumn("reason", F.lit("unrecognized-answer"))


#: Headers of questions, and the spec of the files: patterns of the sections that count and the suffixes of their groups.
BOLD_HEADER = "^\\*\\*\\s*(\\d+)\\s*[.、]\\s*(.+?)\\s*\\*\\*\\s*$"
PRIORITY_SECTIONS = [("^##\\s+第一优先级", "p1"), ("^##\\s+第二优先级", "p2"), ("^##\\s+第三优先级", "p3"), ("^##\\s+第四优先级", "p4")]
KIND_SECTIONS = [("^##\\s+单选题[（(]党史[）)]", "single"), ("^##\\s+多选题[（(]党史[）)]", "multi"), ("^##\\s+判断题[（(]党史[）)]", "judge")]
PART_SECTIONS = [("^##\\s+第一部分", "pdf-single"), ("^##\\s+第二部分", "pdf-multi"), ("^##\\s+第三部分", "pdf-judge")]
CHAPTER = "^##\\s+([一二三四五六七八九十]+)、\\s*(.+?)\\s*$"
PLACEHOLDERS = {"B": "国家", "C": "军队", "D": "政府", "E": "人民"}


def tracked_blocks(lines: DataFrame, sections: list[tuple[str, str]], header: str = BOLD_HEADER, chapters: bool = False) -> DataFrame:
    """(file, group, section_no, part, header, body): question blocks of the sections that count; the others are skipped.

    `sections` are (pattern, suffix of the group); with `chapters`, numbered chapters count too. A block ends at the
    next question, section or rule, and what follows a rule belongs to no block.
    """
    line = F.trim("raw")
    section = line.rlike("^##\\s+")
    group = F.lit("")
    for pattern, suffix in reversed(sections):
        group = F.when(line.rlike(pattern), suffix).otherwise(group)
    if chapters:
        number = chinese_number(F.regexp_extract(line, CHAPTER, 1))
        group = F.when(line.rlike(CHAPTER) & number.between(1, 18), F.concat(F.lit("ch"), number.cast("string"))).otherwise(group)
    order = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(section, "section").when(line.rlike(header), "question").when(line == "---", "rule")
    marked = lines.select("file", "line_no", line.alias("line"), mark.alias("mark"), F.when(section, group).alias("group"))
    placed = marked.select(
        "file", "line_no", "line", "mark", F.last("group", ignorenulls=True).over(order).alias("group"), F.last("mark", ignorenulls=True).over(order).alias("state"),
        F.count_if(F.col("mark") == "section").over(order).alias("section_no"), F.count("mark").over(order).alias("part"),
    )
    inside = placed.where("state = 'question' AND group <> ''")
    rows = F.array_sort(F.collect_list(F.when(F.col("mark").isNull(), F.struct("line_no", "line"))))
    found = inside.groupBy("file", "group", "section_no", "part").agg(F.max(F.when(F.col("mark") == "question", F.col("line"))).alias("header"), rows.alias("rows"))
    return found.select("file", "group", "section_no", "part", "header", F.transform("rows", lambda r: r["line"]).alias("body"))


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """`rows` with new columns that are computed once, however often they are used: a generated row is not folded into what uses it."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def bold_questions(found: DataFrame, variant: str) -> DataFrame:
    """Questions of `tracked_blocks`, numbered within their section; blocks without a usable answer are left out.

    Variants `party` and `military` differ in the answers they know; `military` also takes fill-ins and leaves out
    questions with placeholder options.
    """
    body, trim_end = F.col("body"), lambda c: F.regexp_replace(c, "\\s+$", "")
    answer = "^\\*\\*答案\\*\\*\\s*[:：]\\s*(.+?)\\s*$"
    place = lambda lines, pattern: F.coalesce(F.array_position(F.transform(lines, lambda x: x.rlike(pattern)), True), F.lit(0)).cast("int")
    upto = lambda lines, at: F.when(at > 0, F.slice(lines, F.lit(1), at - 1)).otherwise(lines)
    rows = once(found, at=place(body, answer)).where("at > 0")
    rows = once(rows, raw=F.trim(F.regexp_extract(F.get("body", F.col("at") - 1), answer, 1)), before=F.filter(upto(body, F.col("at")), lambda x: x != ""), rest=F.slice(body, F.col("at") + 1, F.size(body)))
    option = "^[A-J][.、）)]"
    parts = F.flatten(F.transform(F.filter("before", lambda x: x.rlike(option)), lambda x: F.filter(F.transform(F.split(x, "(?=[A-J][.、）)])"), lambda p: F.trim(p)), lambda p: p.rlike(option if variant == "party" else "^[A-J][.、)]"))))
    rows = once(rows, after=upto(F.col("rest"), place(F.col("rest"), "^\\*\\*答案")), parts=parts)
    told = "^\\*\\*解析\\*\\*\\s*[:：]\\s*(.*)$"
    rows = once(rows, given=F.array_compact(F.transform("parts", lambda p: answers.parse_option(p))), at_told=place(F.col("after"), told))
    rows = once(rows, keys=F.transform("given", lambda x: x["key"]))
    first = F.filter("given", lambda o, i: F.array_position("keys", o["key"]) == i + 1)
    at_told = F.col("at_told")
    long = trim_end(F.regexp_replace(F.concat_ws("\n", F.trim(F.regexp_extract(F.get("after", at_told - 1), told, 1)), F.array_join(F.slice("after", at_told + 1, F.size("after")), "\n")), "\n{3,}", "\n\n"))
    short = F.array_join(F.transform(F.filter("after", lambda x: x != ""), lambda x: F.regexp_replace(x, "^\\*\\*(.+?)\\*\\*$", "$1")), "\n")
    words = F.concat(F.array(F.regexp_extract("header", BOLD_HEADER, 2)), upto(F.col("before"), place(F.col("before"), option)))
    rows = once(rows, read=first, stem=F.trim(F.regexp_replace(F.array_join(words, " "), "(?U)\\s+", " ")), explanation=F.trim(F.when(at_told > 0, long).otherwise(short)))
    rows = once(rows, typed=answers.detect_answer(F.col("raw"), F.col("read"), variant=variant)).select("file", "group", "section_no", "part", "raw", "stem", "read", "explanation", "typed")
    kind, normalized, options = F.col("typed.kind"), F.col("typed.normalized"), F.col("read")
    known = F.forall(F.filter(F.split(normalized, ""), lambda k: k != ""), lambda k: F.exists(options, lambda o: o["key"] == k))
    usable = (kind != "skip") & (~kind.isin("single", "multi") | known)
    usable = usable & ((F.size(options) >= 2) if variant == "party" else (F.size(options) >= 2) | kind.isin("judgement", "fill"))
    usable = usable & (F.lit(True) if variant == "party" else ~answers.unusable_template(options, PLACEHOLDERS))
    named = lambda pattern: F.get(F.filter(options, lambda o: o["text"].rlike(pattern)), F.lit(0))
    yes, no = named("^(正确|对)$"), named("^(错误|错)$")
    own = yes.isNotNull() & no.isNotNull()
    judged = normalized == answers.RIGHT
    key = F.when(kind != "judgement", normalized).when(own, F.when(judged, yes["key"]).otherwise(no["key"])).otherwise(F.when(judged, "A").otherwise("B"))
    text = F.when(kind.isin("judgement", "fill"), normalized).otherwise(answers.answer_text(options, normalized))
    shown = F.when((kind == "judgement") & ~own, answers.judgement_options()).otherwise(options)
    number = F.row_number().over(Window.partitionBy("file", "section_no").orderBy("part")).cast("bigint")
    good = rows.where(usable)
    return good.select("file", "group", number.alias("number"), "stem", shown.alias("options"), kind.alias("kind"), key.alias("answer_key"), text.alias("answer_text"), "explanation")


def scoped_blocks(lines: DataFrame, header: str, boundary: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """(file, header_line, body_start, body_end) of the questions in scope; a body ends at the next boundary or the file's end.

    The scope opens at a line that matches `start` and closes at one that matches `end`; without `start` it is the whole file.
    """
    line, never = F.col("raw"), F.lit(False)
    opens, closes = (line.rlike(start) if start else never), (line.rlike(end) if end else never)
    order = Window.partitionBy("file").orderBy("line_no")
    scope = F.last(F.when(opens, True).when(closes, False), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    following = F.first(F.when(line.rlike(boundary), F.col("line_no")), ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    size = F.max("line_no").over(Window.partitionBy("file")) + 1
    placed = lines.select("file", "line_no", (F.coalesce(scope, F.lit(start is None)) & ~opens & ~closes & line.rlike(header)).alias("asked"), F.coalesce(following, size).alias("body_end"))
    return placed.where("asked").select("file", F.col("line_no").alias("header_line"), (F.col("line_no") + 1).alias("body_start"), "body_end")


def bare_options(lines: DataFrame) -> DataFrame:
    """(mode, text): the distinct options without a note, by the kind of exercise they are in."""
    line = F.trim("raw")
    mode = F.when(line.contains("给假名选汉字"), "kana-to-kanji").when(line.contains("给汉字选假名"), "kanji-to-kana")
    pattern = "^-\\s+[A-D][.\\s]+(.+?)(?:\\s*✅)?\\s*$"
    rows = lines.select(running(mode).alias("mode"), line.alias("line"), mode.isNotNull().alias("is_mode"))
    kept = rows.where(~F.col("is_mode") & F.col("mode").isNotNull() & F.col("line").rlike(pattern) & ~F.col("line").contains("【"))
    return kept.select("mode", F.trim(F.regexp_extract("line", pattern, 1)).alias("text")).distinct()


def word_problems(entries: DataFrame) -> DataFrame:
    """(file, lesson, entry, sub, reason) of the entries and sub-questions of `word_entries` that cannot be used.

    An entry has two sub-questions; each has four different options of which one is marked.
    """
    per = Window.partitionBy("file", "lesson", "entry").orderBy("sub")
    rows = entries.select("*", F.count("*").over(per.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("subs"), F.row_number().over(per).alias("nth"))
    texts = F.transform("options", lambda o: o["text"])
    reason = F.when(F.size("options") != 4, F.concat(F.lit("options="), F.size("options").cast("string"))).when(F.size(F.array_distinct(texts)) < F.size(texts), "equal options").when(F.coalesce("answer", F.lit("")) == "", "no answer")
    two = F.col("subs") == 2
    whole = F.when(F.col("nth") == 1, F.concat(F.lit("sub-questions="), F.col("subs").cast("string")))
    label = F.when(two, F.when(F.col("nth") == 1, "A").otherwise("B"))
    return rows.select("file", "lesson", "entry", label.alias("sub"), F.when(two, reason).otherwise(whole).alias("reason")).where("reason IS NOT NULL")


def headings_of(report: DataFrame, lines: DataFrame) -> DataFrame:
    """(file, lesson, num, head, kanji): the heading of each skipped entry of `report`(file, lesson, num) and its Chinese characters."""
    pattern = "^###\\s+(\\d+)\\.\\s+(.+)$"
    heads = lines.where(F.col("raw").rlike(pattern)).groupBy("file", F.regexp_extract("raw", pattern, 1).cast("bigint").alias("num")).agg(F.min_by(F.regexp_extract("raw", pattern, 2), "line_no").alias("title"))
    head = F.trim(F.regexp_extract("title", "^([^（(—]*)", 1))
    return report.join(heads, ["file", "num"]).select("file", "lesson", "num", head.alias("head"), F.regexp_replace(head, "[^一-鿿]", "").alias("kanji"))


def passages(lines: DataFrame, question: str = "^###\\s+第(\\d+)题", article: str = "^(\\*\\*文章[：:]\\*\\*|###\\s+文章[（(].*)$", section: str = "^##\\s") -> DataFrame:
    """(file, number, passage): the passage that each question inherits: the last one before it in its section."""
    line = F.col("line")
    order = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(line.rlike(article), "article").when(line.rlike(section), "section").when(line.rlike(question), "question").when(line == "---", "rule")
    marked = lines.withColumn("mark", mark).withColumn("run", F.sum(F.col("mark").isNotNull().cast("int")).over(order))
    marked = marked.withColumn("state", F.last("mark", ignorenulls=True).over(order)).withColumn("start", F.last(F.when(F.col("mark").isin("article", "section"), F.col("run")), ignorenulls=True).over(order))
    text = marked.where("mark IS NULL AND state = 'article'").groupBy("file", "run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "raw"))), lambda r: r["raw"]), "\n").alias("passage"))
    asked = marked.where("mark = 'question'").select("file", "start", F.regexp_extract("line", question, 1).cast("int").alias("number"))
    return asked.join(text.withColumnRenamed("run", "start"), ["file", "start"], "left").select("file", "number", F.trim("passage").alias("passage"))


def word_entries(lines: DataFrame) -> DataFrame:
    """(file, lesson, entry, headword, kanji, kana, translation, sub, options, answer): options of each sub-question of each entry."""
    line = F.col("line")
    order = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    header = extract(line, "^###\\s+\\d+\\.\\s+(.+)$")
    number = extract(line, "^###\\s+(\\d+)\\.\\s+").cast("int")
    sub = extract(line, "^\\*\\*(.+?)\\*\\*")
    marked = lines.select("file", "line_no", running(extract(line, "^##\\s+第(\\d+)课").cast("int")).alias("lesson"), running(header).alias("headword"), running(number).alias("entry"), F.sum(header.isNotNull().cast("int")).over(order).alias("entry_no"), F.sum(F.coalesce(sub.isNotNull() & ~line.rlike("^###"), F.lit(False)).cast("int")).over(order).alias("sub_no"), answers.parse_word_option(line).alias("option"))
    rows = marked.where("option IS NOT NULL").groupBy("file", "lesson", "entry_no", "entry", "headword", "sub_no").agg(F.array_sort(F.collect_list(F.struct("line_no", "option"))).alias("rows"))
    options = F.transform("rows", lambda r: r["option"])
    rest = F.trim("headword")
    kana = F.trim(F.regexp_extract(rest, "[（(]([^）)]+)[）)]", 1))
    return rows.select("file", "lesson", "entry", rest.alias("headword"), F.trim(F.regexp_replace(rest, "[（(].*$", "")).alias("kanji"), kana.alias("kana"), F.trim(F.when(rest.contains("—"), F.regexp_replace(rest, "^[^—]*—", "")).otherwise("")).alias("translation"), F.col("sub_no").alias("sub"), options.alias("options"), F.get(F.transform(F.filter(options, lambda o: o["correct"]), lambda o: o["key"]), F.lit(-1) + F.greatest(F.size(F.filter(options, lambda o: o["correct"])), F.lit(1))).alias("answer"))


def table_of_contents(files: DataFrame, slug) -> DataFrame:
    """(file, line_no, level, title, slug): headings of level 2 and 3 outside block quotes; repeated slugs get -2, -3."""
    rows = files.select("file", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    pattern = "^(#{2,3})\\s+(.+?)\\s*$"
    heads = rows.where(F.col("line").rlike(pattern)).select("file", "line_no", F.length(F.regexp_extract("line", pattern, 1)).alias("level"), F.trim(F.regexp_replace(F.regexp_extract("line", pattern, 2), "#+$", "")).alias("title"))
    named = heads.withColumn("base", slug(F.col("title")))
    nth = F.row_number().over(Window.partitionBy("file", "base").orderBy("line_no"))
    return named.withColumn("n", nth).select("file", "line_no", "level", "title", F.when(F.col("n") > 1, F.concat_ws("-", "base", F.col("n").cast("string"))).otherwise(F.col("base")).alias("slug"))


def rewritten(kept: DataFrame) -> DataFrame:
    """(file, text): blocks that stay, numbered anew within their section, as one Markdown text."""
    number = F.row_number().over(Window.partitionBy("file", "section").orderBy("block"))
    part = F.concat_ws("\n", F.concat(F.lit("### "), number.cast("string"), F.lit(". "), F.regexp_replace("header", "^#+\\s*\\d+\\s*[.、]\\s*", "")), F.array_join("raw_body", "\n"))
    return kept.withColumn("part", part).groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "part"))), lambda r: r["part"]), "\n").alias("text"))
