"""Text functions as column expressions. Lengths count code points."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The three normalizations strip different signs, and duplicate counts depend on them.
SPACE = "(?U)\\s+"
#: The signs of SPACE one by one, to be taken out without a pattern.
BLANK_SIGNS = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
SIGNS_AUDIT = "[，。、；：！？\"\"''（）()【】《》、,.;:!?'\"\\[\\]<>]"
SIGNS_PARSER = "[，。、；：！？“”‘’\"\"''（）()【】《》、,.;:!?\"'\\[\\]<>—－·…]"
SIGNS_MARKDOWN = "[\\\\，。、；：！？\"\"''（）()【】《》、,.;:!?'\"\\[\\]<>—\\-‐－]"
SOURCE_MARK = "\\[来源[：:].*?\\]"
ANSWER_HINT = "[（(]\\s*[A-E]\\s*[)）]"


def _replace(text: Column, *steps: tuple[str, str]) -> Column:
    return reduce(lambda t, s: F.regexp_replace(t, s[0], s[1]), steps, text)


def char_grams(text: Column, q: int, tails: bool = False) -> Column:
    """Distinct runs of `q` characters; with `tails`, also the shorter ones at the end. A text shorter than `q` is its own run; null and empty texts have none."""
    text = F.coalesce(text, F.lit(""))
    runs = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{1 if tails else q},{q}}}))"), 1)  # one pass; each match looks ahead and takes nothing
    short = F.when(text == "", F.array().cast("array<string>")).otherwise(F.array(text))
    return F.array_distinct(F.when(F.length(text) <= q, short).otherwise(runs) if not tails else runs)


def norm_audit(text: Column) -> Column:
    """Without blanks and signs, in lower case; both go in one pass that looks up characters."""
    return F.lower(F.translate(F.coalesce(text, F.lit("")), BLANK_SIGNS + SIGNS_AUDIT[1:-1].replace("\\", ""), ""))


def norm_parser(text: Column) -> Column:
    return F.lower(_replace(F.coalesce(text, F.lit("")), (SPACE, ""), (SIGNS_PARSER, "")))


def norm_markdown(text: Column) -> Column:
    """Blanks go first, so a bare trailing answer letter stays, as in the original rules."""
    return F.lower(_replace(F.coalesce(text, F.lit("")), (SPACE, ""), (SOURCE_MARK, ""), (ANSWER_HINT, ""), (SIGNS_MARKDOWN, "")))


def norm_full(stem: Column, options: Column, answer: Column) -> Column:
    """Key of stem, options and answer; `options` is array<struct<key, text>>."""
    return F.concat_ws("|", norm_audit(stem), norm_audit(F.array_join(F.transform(options, lambda o: F.concat(o["key"], o["text"])), "")), norm_audit(answer))


def clean_stem(stem: Column) -> Column:
    """One-line stem without source mark and answer hints."""
    trim = lambda c: F.regexp_replace(c, "(?U)^\\s+|\\s+$", "")
    s = trim(F.regexp_replace(stem, SPACE, " "))
    s = trim(F.regexp_replace(s, SOURCE_MARK + "\\s*", ""))
    s = trim(F.regexp_replace(s, "[（(]\\s*([A-E])\\s*[)）]", ""))
    s = trim(F.regexp_replace(s, "\\s+([A-E])$", ""))
    return trim(F.regexp_replace(s, "[（(]\\s*[)）]\\s*$", ""))


def truncate(text: Column, limit: int) -> Column:
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.left(text, F.lit(limit)), F.lit("…")))


def strip_markdown(text: Column) -> Column:
    """Plain text of inline Markdown; line feeds become spaces."""
    return _replace(text, ("\\*\\*([^*]+?)\\*\\*", "$1"), ("\\*([^*]+?)\\*", "$1"), ("`([^`]+?)`", "$1"), ("\\[([^\\]]+?)\\]\\([^)]+?\\)", "$1"), ("\\n", " "))


def escape_html(text: Column) -> Column:
    pairs = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, text)


def render_explanation(text: Column) -> Column:
    """Escaped text with bold marks and line breaks as HTML."""
    return _replace(escape_html(text), ("\\*\\*([^*]+?)\\*\\*", "<strong>$1</strong>"), ("\\n", "<br>"))


def strip_tags(html: Column) -> Column:
    """Text of rendered HTML: no scripts, styles or tags, single spaces."""
    return F.trim(_replace(html, ("(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), ("<[^>]*>", " "), ("\\s+", " ")))


def highlight(text: Column, keyword: str) -> Column:
    """Escaped text with every occurrence of the keyword, in any case, in <mark>."""
    if not keyword:
        return escape_html(text)
    literal = "".join(c if c.isalnum() or ord(c) > 127 else "\\" + c for c in keyword)
    return F.regexp_replace(escape_html(text), f"(?i)({literal})", "<mark>$1</mark>")


def slugify(text: Column) -> Column:
    return _replace(F.lower(F.trim(text)), ("(?U)[\\s.·、，,:：()（）「」]", "-"), ("[^\\p{L}\\p{N}-]", ""), ("-+", "-"), ("^-|-$", ""))


def plain_ruby(html: Column) -> Column:
    """Ruby annotations whose reading equals the text become the text."""
    return F.regexp_replace(html, "<ruby>([^<]+)<rp>[^<]*</rp><rt>\\1</rt><rp>[^<]*</rp></ruby>", "$1")


def headings_with_ids(html: Column) -> Column:
    """`<h2>` and `<h3>` of plain text get their slug as id; done by splitting, so each heading has its own slug."""
    parts = F.split(html, "(?=<h[23]>)")

    def mark(part: Column) -> Column:
        tag, title = F.regexp_extract(part, "^<(h[23])>([^<]+)</h[23]>", 1), F.regexp_extract(part, "^<(h[23])>([^<]+)</h[23]>", 2)
        return F.when(tag != "", F.concat(F.lit("<"), tag, F.lit(' id="'), slugify(title), F.lit('">'), F.substring(part, F.lit(5), F.length(part)))).otherwise(part)

    return F.array_join(F.transform(parts, mark), "")


def context_around(text: Column, found: Column, size: int = 200) -> Column:
    """Up to `size` code points on both sides of the first occurrence; null where there is none."""
    at = F.instr(text, found)
    start = F.greatest(at - size, F.lit(1))
    before, after = F.substring(text, start, at - start), F.substring(text, at + F.length(found), F.lit(size))
    return F.when(at > 0, F.struct(before.alias("before"), after.alias("after")))


def explicit_tags(explanation: Column) -> Column:
    """Tags of the line `**标签**：a·b、c`."""
    line = F.regexp_extract(explanation, "(?m)^\\*\\*标签\\*\\*\\s*[：:]\\s*(.+?)\\s*$", 1)
    return F.filter(F.transform(F.split(line, "[·,，、]"), lambda t: F.trim(t)), lambda t: t != "")


def match_tags(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Distinct names of the rules (name, pattern) that occur in the text, in the order of the rules."""
    return F.array_distinct(F.array_compact(F.array(*[F.when(text.rlike(pattern), F.lit(name)) for name, pattern in rules])))


def chinese_number(text: Column) -> Column:
    """一 to 十九 as a number; null for anything else."""
    digits = "一二三四五六七八九"
    value = lambda c: F.when(c == "", 0).otherwise(F.instr(F.lit(digits), c))
    tens, ones = F.regexp_extract(text, "^([一]?十)?", 1), F.regexp_replace(text, "^[一]?十", "")
    return F.when(text.rlike(f"^([一]?十)?[{digits}]?$") & (text != ""), F.when(tens != "", 10).otherwise(0) + value(ones)).cast("bigint")


def normalize_sections(text: Column) -> Column:
    """Every known section header of a generated explanation on its own line, with one blank line before."""
    # fixed values: the section names of an explanation
    names = "考点|标签|正确答案|干扰项分析|判断依据|易错点|拓展"
    s = F.regexp_replace(text, "(?U)^\\s+|\\s+$", "")
    s = F.regexp_replace(s, f"(?U)\\s*(\\*\\*(?:{names})\\*\\*)", "\n\n$1")
    return F.regexp_replace(F.regexp_replace(s, "\n{3,}", "\n\n"), "(?U)^\\s+|\\s+$", "")


#: The label of an answer in its three forms.
def labelled_answer(line: Column) -> Column:
    """Answer of `**答案**：X`, `**答案：X**` or `**答案**：X **`; null for other lines."""
    first = F.regexp_extract(line, "^\\*\\*\\s*答案\\s*\\*\\*\\s*[：:]\\s*(.+?)\\s*$", 1)
    second = F.regexp_extract(line, "^\\*\\*\\s*答案\\s*[：:]\\s*(.+?)\\s*\\*\\*\\s*$", 1)
    return F.coalesce(F.nullif(first, F.lit("")), F.nullif(second, F.lit("")))


def valid_explanation(text: Column) -> Column:
    return F.coalesce(~text.contains("```") & text.contains("**考点**"), F.lit(False))


def already_enriched(explanation: Column) -> Column:
    """A line with the label 考点 and a colon directly after it."""
    return F.coalesce(explanation.rlike("(?m)^(>\\s*)?.*\\*\\*\\s*考点\\s*[：:]"), F.lit(False))


#: Tags of a question bank and the words that earn them, in order.
HISTORY_TAGS = [
    ("鸦片战争", "鸦片战争"), ("南京条约", "《南京条约》"), ("马关条约", "《马关条约》"), ("辛丑条约", "《辛丑条约》"), ("北京条约", "《北京条约》"),
    ("太平天国", "太平天国|洪秀全"), ("洋务运动", "洋务"), ("戊戌维新", "戊戌|维新"), ("辛亥革命", "辛亥革命|孙中山"), ("中共党史", "中共[一大二三四大五六七大]"),
    ("国共合作", "国共合作|统一战线"), ("南昌起义", "南昌起义"), ("秋收起义", "秋收起义"), ("长征", "长征|遵义会议"), ("抗日战争", "抗日战争|抗日|九一八|七七"),
    ("解放战争", "解放战争|三大战役"), ("新文化运动", "新文化运动"), ("五四运动", "五四运动"), ("半殖民地半封建", "半殖民地半封建"),
]
PARTY_TAGS = [
    ("党的指导思想", "党的指导思想|马克思列宁主义|毛泽东思想|邓小平理论|三个代表|科学发展观|习近平新时代中国特色社会主义思想"), ("党章知识", "党章|党员的[权利义务]|党的[中央基层纪律]组织|民主集中制"),
    ("党的性质宗旨", "党的性质|党的宗旨|先锋队|全心全意为人民服务"), ("党史重大事件", "南昌起义|秋收起义|长征|遵义会议|中共[一大二大三四十大]"), ("抗日战争", "抗日战争|九一八|七七事变|抗日民族统一战线"),
    ("解放战争", "解放战争|三大战役"), ("改革开放", "改革开放|经济特区|社会主义市场经济"), ("新时代", "新时代|中国梦|中华民族伟大复兴|两个一百年"), ("一国两制", "一国两制|港人治港|澳人治澳"),
    ("社会主义初级阶段", "社会主义初级阶段|基本路线|基本纲领"),
]
MILITARY_TAGS = [
    ("国防", "国防|国防动员|国防法规|国防类型"), ("国家安全", "国家安全|周边安全"), ("毛泽东军事思想", "毛泽东军事思想|人民战争"), ("武装力量", "武装力量|解放军|预备役|民兵"), ("现代战争", "现代战争|信息化战争|精确制导"),
    ("孙子兵法", "孙子兵法|孙武"), ("军事技术", "激光|雷达|导弹|航天|电子战|核生化|C4ISR"), ("战略战术", "战略|战术|作战理论"), ("党史军史", "南昌起义|秋收起义|建军节|中央军委"), ("法律法规", "国防法|兵役法|国防教育法"),
]
KIND_TAGS = (("multi", "多选题"), ("judgement", "判断题"), ("single", "单选题"), ("fill", "填空题"))


def question_tags(kind: Column, stem: Column, explanation: Column, rules: list[tuple[str, str]], title: Column | None = None) -> Column:
    """Tags of a question: its chapter (from the group's title), its kind, those named in the explanation, those by rules; each once."""
    chapter = F.coalesce(*[F.nullif(F.regexp_extract(title, f"第([一二三四五六七八九十]+){unit}", 1), F.lit("")) for unit in "套章"]) if title is not None else F.lit(None).cast("string")
    own = [F.concat(F.lit("第"), chapter, F.lit("章")), *[F.when(kind == k, F.lit(name)) for k, name in KIND_TAGS]]
    text = F.concat_ws(" ", stem, explanation)
    return F.array_distinct(F.concat(F.array_compact(F.array(*own)), explicit_tags(explanation), match_tags(text, rules)))
