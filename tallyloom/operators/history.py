"""Markdown banks with block quotes, sub-sets and fill-in sections, as typed questions.

Marks cut a file: sub-sets (in files that have them), headings of question kinds and chapters, question
headers, rules. Every line knows the last mark of each sort, so a block is the lines below its header up to
the next mark. A sub-set starts a new group with numbers of its own; below a fill-in heading, questions have
no options and their answers are texts.

Blocks without an answer, with letters that no option has, or without options to choose from are left out;
numbers count the questions that stay. A file without a row in the specs is not read; null text gives no lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.functions import answers
from tallyloom.functions.text import clean_stem
from tallyloom.operators.markdown import once

#: Patterns of the format.
HEADER = "^(?:>\\s*)?#{3,4}\\s+\\d+[.、]\\s*(.*)$"
SUBSET = "^##\\s+第([一二三四])套(?:\\s|$)"
FILL_HEADING = "^###\\s+填空题$"
KIND_HEADING = "^###\\s+(?:单选题|多选题|判断题)"
ANY_FILL_HEADING = "^###\\s+填空题"
CHAPTER_HEADING = "^##\\s+第[一二三四五六七八九十]+章"
ANSWER = "^\\*\\*\\s*答案\\s*[:：]\\s*(.+?)\\s*\\*\\*"
NEXT_ANSWER = "^\\*\\*\\s*答案"
EXPLANATION = "^\\*\\*\\s*解析\\s*[:：]\\s*\\*{0,2}\\s*(.*)$"
OPTION = "^[A-J][.、）)]"
SUBSET_SIGNS = "一二三四"


def marked_blocks(lines: DataFrame, specs: DataFrame) -> DataFrame:
    """(file, group, title, set_no, part, fill, header, body) of `lines`(file, line_no, raw).

    `specs`(file, group, title, subsets): base group and title of each file, and whether it has sub-sets. `set_no`
    counts the sub-set headings before the block, `part` the marks; `body` has the trimmed lines in order.
    """
    bare = F.regexp_replace("raw", "^>\\s?", "")
    mine = specs.select(F.col("file").alias("_file"), F.col("group").alias("base"), F.col("title").alias("base_title"), F.coalesce("subsets", F.lit(False)).alias("subsets"))
    read = lines.where("raw IS NOT NULL").select("file", "line_no", "raw").join(mine, F.col("file") == F.col("_file"))
    read = once(read, bare=bare, line=_trim(bare))
    line = F.col("line")
    mark = (
        F.when(F.col("subsets") & F.col("bare").rlike(SUBSET), "set")
        .when(line.rlike(FILL_HEADING), "fill")
        .when(line.rlike(KIND_HEADING) | line.rlike(CHAPTER_HEADING), "kind")
        .when(line.rlike(HEADER), "question")
        .when((line == "---") | line.rlike(ANY_FILL_HEADING), "rule")
    )
    rows = once(read.select("file", "line_no", "base", "base_title", "bare", "line", mark.alias("mark")), sign=F.when(F.col("mark") == "set", F.regexp_extract("bare", SUBSET, 1)))
    order = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c: F.last(c, ignorenulls=True).over(order)
    fill = F.when(F.col("mark") == "fill", True).when(F.col("mark").isin("set", "kind"), False)
    placed = rows.select(
        "file", "line_no", "base", "base_title", "line", "mark", last("mark").alias("state"), last("sign").alias("sign"), F.coalesce(last(fill), F.lit(False)).alias("fill"),
        F.count("sign").over(order).alias("set_no"), F.count("mark").over(order).alias("part"),
    )
    number = F.instr(F.lit(SUBSET_SIGNS), F.col("sign")).cast("string")
    group = F.when(F.col("sign").isNull(), F.col("base")).otherwise(F.concat("base", F.lit("-"), number))
    title = F.when(F.col("sign").isNull(), F.col("base_title")).otherwise(F.concat("base_title", F.lit(" 第"), "sign", F.lit("套")))
    inside = placed.where("state = 'question'").select("file", "line_no", "line", "mark", group.alias("group"), title.alias("title"), "set_no", "part", "fill")
    below = F.array_sort(F.collect_list(F.when(F.col("mark").isNull(), F.struct("line_no", "line"))))
    found = inside.groupBy("file", "group", "title", "set_no", "part", "fill").agg(F.max(F.when(F.col("mark") == "question", F.col("line"))).alias("header"), below.alias("rows"))
    return found.select("file", "group", "title", "set_no", "part", "fill", "header", F.transform("rows", lambda r: r["line"]).alias("body"))


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, "(?U)^\\s+|\\s+$", "")


def _place(lines: Column, pattern: str) -> Column:
    """Place (from 1) of the first line that matches, 0 without one."""
    return F.coalesce(F.array_position(F.transform(lines, lambda x: x.rlike(pattern)), True), F.lit(0)).cast("int")


def _before(lines: Column, place: Column) -> Column:
    return F.when(place > 0, F.slice(lines, F.lit(1), place - 1)).otherwise(lines)


def _from(lines: Column, place: Column) -> Column:
    return F.slice(lines, place, F.size(lines))


def _explanation(after: Column, place: Column) -> Column:
    """Text below the answer: from the line that opens an explanation, or all lines that are not empty, unbolded."""
    opened = F.regexp_replace(_trim(F.regexp_extract(F.get(after, place - 1), EXPLANATION, 1)), "^\\*{1,2}\\s*", "")
    long = F.regexp_replace(F.concat_ws("\n", opened, F.array_join(_from(after, place + 1), "\n")), "\n{3,}", "\n\n")
    short = F.array_join(F.transform(F.filter(after, lambda x: x != ""), lambda x: F.regexp_replace(x, "^\\*\\*(.+?)\\*\\*$", "$1")), "\n")
    return _trim(F.when(place > 0, long).otherwise(short))


def history_questions(found: DataFrame) -> DataFrame:
    """(file, group, title, number, stem, options, kind, answer_key, answer_text, explanation) of `marked_blocks`."""
    rows = once(found, at=_place(F.col("body"), ANSWER)).where("at > 0")
    rows = once(rows, raw=_trim(F.regexp_extract(F.get("body", F.col("at") - 1), ANSWER, 1)), asked=F.filter(_before(F.col("body"), F.col("at")), lambda x: x != ""), rest=_from(F.col("body"), F.col("at") + 1))
    pieces = F.flatten(F.transform(F.filter("asked", lambda x: x.rlike(OPTION)), lambda x: F.filter(F.transform(F.split(x, "(?=[A-J][.、）)])"), _trim), lambda p: p.rlike("^[A-J][.、)]"))))
    rows = once(rows, first=_place(F.col("asked"), OPTION), after=_before(F.col("rest"), _place(F.col("rest"), NEXT_ANSWER)), given=F.array_compact(F.transform(pieces, answers.parse_option)))
    rows = once(rows, keys=F.transform("given", lambda o: o["key"]), at_told=_place(F.col("after"), EXPLANATION))
    options = F.when(F.col("fill"), F.slice("given", 1, 0)).otherwise(F.filter("given", lambda o, i: F.array_position("keys", o["key"]) == i + 1))
    words = F.when(F.col("fill"), F.col("asked")).otherwise(_before(F.col("asked"), F.col("first")))
    stem = clean_stem(F.array_join(F.concat(F.array(_trim(F.regexp_extract("header", HEADER, 1))), words), " "))
    rows = once(rows, read=options, stem=stem, told=_explanation(F.col("after"), F.col("at_told")), letter=F.upper("raw"))
    judged = ~F.col("fill") & answers.is_judgement_options(F.col("read")) & F.col("letter").rlike("^[AB]$")
    chosen = F.get(F.filter("read", lambda o: o["key"] == F.col("letter")), F.lit(0))["text"]
    typed = F.when(judged, F.struct(F.lit("judgement").alias("kind"), F.coalesce(chosen, F.lit(answers.RIGHT)).alias("normalized"))).otherwise(answers.detect_answer(F.col("raw"), F.col("read"), F.col("fill")))
    rows = once(rows, typed=typed).select("file", "group", "title", "set_no", "part", "stem", "read", "told", "typed.kind", "typed.normalized")
    read, kind, normalized = F.col("read"), F.col("kind"), F.col("normalized")
    known = F.forall(F.filter(F.split(normalized, ""), lambda k: k != ""), lambda k: F.exists(read, lambda o: o["key"] == k))
    usable = (kind == "fill") | ((kind == "judgement") & ((F.col("stem") != "") | (F.size(read) > 0))) | ((kind == "single") & (F.size(read) > 0)) | ((kind == "multi") & known)
    key = F.when(kind == "judgement", F.when(normalized == answers.RIGHT, "A").otherwise("B")).when(kind == "fill", "FILL").otherwise(normalized)
    text = F.when(kind.isin("judgement", "fill"), normalized).otherwise(answers.answer_text(read, normalized))
    shown = F.when(kind == "judgement", answers.judgement_options()).otherwise(read)
    number = F.row_number().over(Window.partitionBy("file", "set_no").orderBy("part")).cast("bigint")
    return rows.where(usable).select("file", "group", "title", number.alias("number"), "stem", shown.alias("options"), "kind", key.alias("answer_key"), text.alias("answer_text"), F.col("told").alias("explanation"))
