"""Column functions for labels, categories, entry headers and prompts. Null parts count as empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions.text import already_enriched

#: Categories by the start of a question id, and the default.
PREFIXES = {"hist": "history", "party": "party", "mil": "military"}
DEFAULT_CATEGORY = "japanese2"
LEGACY_CATEGORIES = ["word", "grammar"]


def _some(x: Column) -> Column:
    """`x`, or null where it is empty."""
    return F.nullif(x, F.lit(""))


def legacy_category(value: Column) -> Column:
    """Stored categories of old versions and missing ones become the default."""
    return F.when(value.isin(LEGACY_CATEGORIES), DEFAULT_CATEGORY).otherwise(F.coalesce(_some(value), F.lit(DEFAULT_CATEGORY)))


def category_of_id(question_id: Column) -> Column:
    out = F.lit(DEFAULT_CATEGORY)
    for prefix, category in PREFIXES.items():
        out = F.when(F.coalesce(question_id, F.lit("")).startswith(prefix), category).otherwise(out)
    return out


def stars(level: Column) -> Column:
    """Mastery 0 to 5 as filled and empty stars."""
    return F.concat(F.repeat(F.lit("★"), level.cast("int")), F.repeat(F.lit("☆"), (5 - level).cast("int")))


def entry_header(line: Column) -> Column:
    """Parts of `### 12. 漢字（かな） — translation` as a struct; null for other lines."""
    rest = F.btrim(F.regexp_extract(line, "^###\\s+(\\d+)\\.\\s+(.+)$", 2))
    head = F.struct(
        F.regexp_extract(line, "^###\\s+(\\d+)\\.", 1).try_cast("bigint").alias("num"),
        rest.alias("headword"),
        F.btrim(F.regexp_extract(rest, "^([^（(]*)", 1)).alias("kanji"),
        F.btrim(F.regexp_extract(rest, "[（(]([^）)]+)[）)]", 1)).alias("kana"),
        F.btrim(F.regexp_extract(rest, "—(.*)$", 1)).alias("translation"),
    )
    return F.when(line.rlike("^###\\s+\\d+\\.\\s+.+$"), head)


def with_article(stem: Column, article: Column) -> Column:
    return F.concat_ws("\n\n", _some(article), stem)


def shares_reading(word: Column, reference: Column) -> Column:
    """Whether a character of `word` outside kana occurs in `reference`, which names a word at all."""
    han = F.filter(F.split(word, ""), lambda c: c.rlike("^[一-鿿]$"))
    named = ~reference.contains("无") & ~reference.contains("無")
    return F.coalesce(F.exists(han, lambda c: F.contains(reference, c)) & named, F.lit(False))


#: The wording of the prompts below is that which stored answers were made with.
def explanation_prompt(stem: Column, options: Column, answer_key: Column, answer_text: Column, explanation: Column, selected: Column, correct: Column) -> Column:
    """Request for an explanation of a question; the stored explanation and the learner's choice are optional."""
    listed = F.array_join(F.transform(options, lambda o: F.concat(o["key"], F.lit(". "), o["text"])), "\n")
    answer = F.concat_ws(". ", F.coalesce(answer_key, F.lit("")), _some(answer_text))
    return F.concat_ws(
        "\n\n",
        F.lit("请详细解析以下题目："),
        F.concat(F.lit("【题干】\n"), F.coalesce(stem, F.lit(""))),
        F.concat(F.lit("【选项】\n"), F.coalesce(listed, F.lit(""))),
        F.concat(F.lit("【正确答案】"), answer),
        F.concat(F.lit("【原题库解析】（可能不准确，请甄别后使用）\n"), _some(explanation)),
        F.concat(F.lit("【用户选择】"), _some(selected), F.lit("\n用户"), F.when(correct, "答对了").otherwise("答错了"), F.lit("，请针对用户的理解情况进行讲解。")),
    )


def note_context(title: Column, section: Column, selected: Column, before: Column, after: Column) -> Column:
    """What surrounds a selection in a note; without a selection only the title."""
    chosen = lambda label, x, close="": F.when(selected.isNotNull(), F.concat(F.lit(label), _some(x), F.lit(close)))
    text = F.when(selected.isNotNull(), F.concat(F.lit("用户选中的文字：「"), selected, F.lit("」")))
    return F.concat_ws("\n", F.concat(F.lit("笔记标题："), _some(title)), chosen("所在章节：", section), text, chosen("选中文字前面的内容：", before), chosen("选中文字后面的内容：", after))


def api_dialect(base_url: Column) -> Column:
    """Format of a chat service, by its address."""
    return F.when(F.contains(F.coalesce(base_url, F.lit("")), F.lit("anthropic")), "anthropic").otherwise("openai")


#: Wording of the request for a structured explanation; answers are parsed by these labels.
KINDS = {"single": "单选", "multi": "多选"}
JUDGED = "判断"
JUDGEMENT_FORM = "**考点**：<10-25字具体知识点>\n\n**标签**：<3-5个标签，用 · 分隔>\n\n**判断依据**：<为什么是这个判断，2-4句话>\n\n**易错点**：<常见错误认知或易混淆点，1-2句话>"
CHOICE_FORM = "**考点**：<10-25字具体知识点>\n\n**标签**：<3-5个标签，用 · 分隔>\n\n**正确答案**：<正确选项字母. 选项文本 — 一句话解释为什么对>\n\n**干扰项分析**：\n"
NO_DISTRACTORS = "<无干扰项>"
WHY_WRONG = " — <为什么错，一句话>"
EXTENSION = "\n\n**拓展**：<1-2句相关背景，如时间、人物、影响>"
DEMANDS = "【要求】\n1. 解释要具体、准确，紧扣本题考点，不要通用套话\n2. 干扰项分析只列错误选项，每个错误选项一句话说明为什么错\n3. 标签用 · 分隔，3-5 个，关键词级别的（如\"鸦片战争 · 半殖民地半封建社会 · 南京条约\"）\n4. 用简体中文，简明扼要\n5. 直接输出 markdown，不要前缀说明"
OUTPUT_FORM = "【输出格式】（严格按以下 markdown 输出，不要任何其他文字，不要 ``` 代码块包裹）\n"


def enrichment_prompt(kind: Column, stem: Column, options: Column, correct: Column, category: Column) -> Column:
    """Request for a structured explanation; its form depends on the kind of question and lists the wrong options."""
    shown = lambda o: F.concat(o["key"], F.lit(". "), o["text"])
    right = F.filter(F.transform(F.split(correct, ""), lambda k: F.get(F.filter(options, lambda o: o["key"] == k), F.lit(0))), lambda o: o.isNotNull())
    wrong = F.filter(options, lambda o: ~correct.contains(o["key"]))
    cut = lambda t: F.when(F.length(t) > 30, F.concat(F.left(t, F.lit(30)), F.lit("…"))).otherwise(t)
    distractors = F.array_join(F.transform(wrong, lambda o: F.concat(F.lit("- "), o["key"], F.lit(". "), cut(o["text"]), F.lit(WHY_WRONG))), "\n")
    form = F.when(kind == "judgement", JUDGEMENT_FORM).otherwise(F.concat(F.lit(CHOICE_FORM), F.when(F.size(wrong) > 0, distractors).otherwise(NO_DISTRACTORS), F.lit(EXTENSION)))
    label = F.when(kind == "single", KINDS["single"]).when(kind == "multi", KINDS["multi"]).otherwise(JUDGED)
    described = F.coalesce(F.nullif(F.array_join(F.transform(right, shown), " / "), F.lit("")), correct)
    return F.concat(
        F.lit("你是"), category, F.lit("考试题库的解析编写专家。请为下面的"), label, F.lit("题生成结构化解析。\n\n【题干】\n"), stem,
        F.lit("\n\n【选项】\n"), F.array_join(F.transform(options, shown), "\n"), F.lit("\n\n【正确答案】"), described, F.lit("\n\n" + OUTPUT_FORM), form, F.lit("\n\n" + DEMANDS),
    )


def is_eligible(explanation: Column, force: Column) -> Column:
    """Whether a question is to be explained (again): not explained yet, or asked for."""
    return force | ~already_enriched(F.coalesce(explanation, F.lit("")))
