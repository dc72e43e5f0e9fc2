"""Answers: types, grading, option handling. Options are array<struct<key, text>>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RIGHT, WRONG = "正确", "错误"


def sorted_letters(text: Column) -> Column:
    """The distinct letters of an answer in order."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))), "")


def same_letters(selected: Column, answer: Column) -> Column:
    return sorted_letters(selected) == sorted_letters(answer)


def toggle_letter(current: Column, key: Column) -> Column:
    """`current` with `key` added, or taken out if it is there; letters in order."""
    letters = F.filter(F.split(current, ""), lambda c: c != "")
    return F.array_join(F.array_sort(F.array_distinct(F.when(F.array_contains(letters, key), F.array_remove(letters, key)).otherwise(F.array_append(letters, key)))), "")


def grade(question_type: Column, multi: Column, selected: Column, answer_key: Column, answer_text: Column) -> Column:
    """Whether an answer is right: fill-ins ignore case and outer blanks, multiple answers ignore order."""
    fill = F.lower(F.trim(selected)) == F.lower(F.trim(answer_text))
    return F.when(question_type == "fill", fill).when(multi, same_letters(selected, answer_key)).otherwise(selected == answer_key)


def _clean(raw: Column) -> Column:
    return F.upper(F.regexp_replace(raw, "(?U)[.。、\\s]", ""))


def _kind(kind: str | Column, normalized: Column) -> Column:
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), normalized.alias("normalized"))


def _letters_kind(letters: Column) -> Column:
    # repeated letters stay: the original sorts without removing any
    ordered = F.array_join(F.array_sort(F.filter(F.split(letters, ""), lambda c: c != "")), "")
    return _kind(F.when(F.length(letters) > 1, "multi").otherwise("single"), ordered)


def _judgement(cleaned: Column) -> Column:
    return _kind("judgement", F.when(cleaned == "对", RIGHT).when(cleaned == "错", WRONG).otherwise(cleaned))


def _match(options: Column, text: Column) -> Column:
    """Key of the first option with the same text, up to dots, commas and blanks."""
    plain = lambda c: F.lower(F.regexp_replace(c, "(?U)[.。、\\s]", ""))
    return F.get(F.filter(options, lambda o: plain(o["text"]) == plain(text)), 0)["key"]


def detect_answer(raw: Column, options: Column | None = None, fill: Column | None = None, variant: str = "history") -> Column:
    """struct(kind, normalized) of a raw answer; kind: single, multi, judgement, fill or skip.

    Variants: `history` (letters and judgements), `party` (also the text of an option), `military` (also
    without a bracketed remark, with several option texts, and fill-ins where there are no options).
    """
    text = F.trim(F.regexp_replace(raw, "[（(].*$", "")) if variant == "military" else raw
    cleaned = _clean(text)
    letters = F.regexp_extract(cleaned, "[A-J]+", 0)
    skip = _kind("skip", F.lit(""))
    out = F.when(cleaned.rlike(f"^({RIGHT}|{WRONG}|对|错)$"), _judgement(cleaned)).when(cleaned.rlike("^[A-J]+$"), _letters_kind(cleaned))
    if variant != "history":
        out = out.when(_match(options, text).isNotNull(), _kind("single", _match(options, text)))
    if variant == "military":
        named = F.filter(options, lambda o: text.contains(o["text"]) & (F.length(o["text"]) >= 2))
        out = out.when(F.size(named) >= 2, _kind("multi", F.array_join(F.array_sort(F.transform(named, lambda o: o["key"])), "")))
    out = out.when(letters != "", _letters_kind(letters))
    if variant == "military":
        out = out.when(F.size(options) == 0, _kind("fill", text))
    out = out.otherwise(skip)
    return out if fill is None else F.when(fill, _kind("fill", F.trim(raw))).otherwise(out)


def is_judgement_options(options: Column) -> Column:
    has = lambda t: F.exists(options, lambda o: o["text"] == t)
    return (F.size(options) == 2) & has(RIGHT) & has(WRONG)


def judgement_options() -> Column:
    """The two options of a judgement."""
    return F.array(*[F.struct(F.lit(k).alias("key"), F.lit(t).alias("text")) for k, t in (("A", RIGHT), ("B", WRONG))])


def answer_text(options: Column, letters: Column) -> Column:
    """Texts of the chosen options, joined by ` / `, in option order."""
    return F.array_join(F.transform(F.filter(options, lambda o: letters.contains(o["key"])), lambda o: o["text"]), " / ")


def split_options(line: Column) -> Column:
    """Parts of a line `A、x B、y C、z`; null unless it has two options or more."""
    parts = F.filter(F.transform(F.split(F.trim(line), "(?=[A-J][.、）)])"), lambda p: F.trim(p)), lambda p: p != "")
    good = F.trim(line).rlike("^[A-J][.、）)]") & (F.size(parts) >= 2) & F.forall(parts, lambda p: p.rlike("^[A-J][.、)]"))
    return F.when(good, parts)


def parse_option(line: Column) -> Column:
    """struct(key, text) of `A. text`; null for other lines."""
    key = F.regexp_extract(line, "^([A-J])[.、）)]\\s*(.+)$", 1)
    return F.when(key != "", F.struct(key.alias("key"), F.trim(F.regexp_extract(line, "^([A-J])[.、）)]\\s*(.+)$", 2)).alias("text")))


def parse_word_option(line: Column) -> Column:
    """struct(key, text, correct, annotation) of `- A. text【note】 ✅`; null for other lines."""
    pattern = "^-\\s+([A-D])[.、\\s]+(.+?)\\s*$"
    key, body = F.regexp_extract(line, pattern, 1), F.trim(F.regexp_extract(line, pattern, 2))
    bare = F.trim(F.regexp_replace(body, "^(.*?)【.+?】", "$1"))
    text = F.regexp_replace(bare, "^(.+?)\\s*✅\\s*$", "$1")
    return F.when(key != "", F.struct(key.alias("key"), F.trim(text).alias("text"), bare.rlike("^.+?\\s*✅\\s*$").alias("correct"), F.trim(F.regexp_extract(body, "【(.+?)】", 1)).alias("annotation")))


def option_flags(options: Column, selected: Column, answer: Column) -> Column:
    """Each option with chosen, correct, wrong (chosen, not right) and missed (right, not chosen)."""

    def flags(o: Column) -> Column:
        chosen, right = selected.contains(o["key"]), answer.contains(o["key"])
        return F.struct(o["key"].alias("key"), chosen.alias("chosen"), right.alias("correct"), (chosen & ~right).alias("wrong"), (~chosen & right).alias("missed"))

    return F.transform(options, flags)


def shuffle_options(options: Column, answer: Column, multi: Column, question_id: Column, seed: str) -> Column:
    """struct(options, answer): options in an order that follows from the seed, relabelled from A; multiple answers stay."""
    mixed = F.array_sort(F.transform(options, lambda o: F.struct(F.md5(F.concat_ws("/", F.lit(seed), question_id.cast("string"), o["key"])).alias("h"), o["key"].alias("old"), o["text"].alias("text"))))
    relabelled = F.transform(mixed, lambda o, i: F.struct(F.char(i + 65).alias("key"), o["text"].alias("text")))
    place = F.array_position(F.transform(mixed, lambda o: o["old"]), answer)
    stays = multi | ~F.exists(options, lambda o: o["key"] == answer)
    return F.when(stays, F.struct(options.alias("options"), answer.alias("answer"))).otherwise(F.struct(relabelled.alias("options"), F.char(place + 64).alias("answer")))


def unusable_template(options: Column, template: dict[str, str]) -> Column:
    """Whether five options or more carry the placeholder texts of `template`."""
    out = F.size(options) >= 5
    for key, text in template.items():
        out = out & F.array_contains(options, F.struct(F.lit(key).alias("key"), F.lit(text).alias("text")))
    return out


def type_label(question_type: Column) -> Column:
    # fixed values: shown names of the question types
    names = {"judgement": "判断题", "multi": "多选题", "single": "单选题", "fill": "填空题"}
    out = F.lit("")
    for kind, name in names.items():
        out = F.when(question_type == kind, name).otherwise(out)
    return out


def cell_status(correct: Column, draft: Column) -> Column:
    return F.when(correct, "correct").when(~correct, "wrong").when(F.coalesce(draft, F.lit("")) != "", "draft").otherwise("unanswered")


def question_id(group: Column, number: Column, width: int = 5) -> Column:
    return F.concat(group, F.lit("-q"), F.lpad(number.cast("string"), width, "0"))


def entry_key(*parts: Column) -> Column:
    """Signature of a quiz entry: its parameters joined by bars, missing ones empty."""
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
