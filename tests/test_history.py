"""Questions of the history format against a plain walk over the lines."""

import random
import re

from tallyloom.operators import history, markdown

SIGNS = {"一": "1", "二": "2", "三": "3", "四": "4"}
LINES = ["", "## 第一套", "> ## 第二套 x", "## 第三章", "### 填空题", "### 填空题（补）", "### 单选题", "---", "> ---", "### 7. one", "> #### 8、 two（B）", "> > ### 9. ", "plain", "A. x B. y", "B、正确", "A. 正确",
         "B. 错误", "A) z", "**答案：A**", "**答案: BA** ", "> **答案：对**", "**答案：说不清**", "**答案：C**", "**解析：** because", "**解析：**", "**bold**", "A. x C. w"]


def walk(text, group, title, subsets):
    """Blocks as (group, title, set_no, fill, header, body), one line after the other."""
    found, open_block, fill, set_no, sign = [], None, False, 0, None
    for raw in text.split("\n"):
        bare = re.sub(r"^>\s?", "", raw)
        line = bare.strip()
        subset = re.match(history.SUBSET, bare) if subsets else None
        if subset:
            sign, set_no, fill, open_block = subset[1], set_no + 1, False, None
        elif re.match(history.ANY_FILL_HEADING, line):
            fill, open_block = fill or line == "### 填空题", None
        elif re.match(history.KIND_HEADING, line) or re.match(history.CHAPTER_HEADING, line):
            fill, open_block = False, None
        elif re.match(history.HEADER, line):
            open_block = (group + (f"-{SIGNS[sign]}" if sign else ""), title + (f" 第{sign}套" if sign else ""), set_no, fill, line, [])
            found.append(open_block)
        elif line == "---":
            open_block = None
        elif open_block:
            open_block[5].append(line)
    return found


def question(block):
    """(stem, option keys, kind, answer_key, explanation) of a block; None if it does not count."""
    *_, fill, header, body = block
    answers = [i for i, x in enumerate(body) if re.match(history.ANSWER, x)]
    if not answers:
        return None
    raw = re.match(history.ANSWER, body[answers[0]])[1].strip()
    before, rest = [x for x in body[: answers[0]] if x], body[answers[0] + 1 :]
    stop = next((i for i, x in enumerate(rest) if re.match(history.NEXT_ANSWER, x)), len(rest))
    after = rest[:stop]
    told = next((i for i, x in enumerate(after) if re.match(history.EXPLANATION, x)), None)
    if told is None:
        explanation = "\n".join(re.sub(r"^\*\*(.+?)\*\*$", r"\1", x) for x in after if x)
    else:
        explanation = re.sub(r"\n{3,}", "\n\n", "\n".join([re.match(history.EXPLANATION, after[told])[1].strip(), *after[told + 1 :]])).strip()
    first = next((i for i, x in enumerate(before) if re.match(history.OPTION, x)), len(before))
    words = before if fill else before[:first]
    stem = " ".join(" ".join([re.match(history.HEADER, header)[1], *words]).split())
    stem = re.sub(r"\s+[A-E]$", "", re.sub(r"[（(]\s*[A-E]\s*[)）]", "", stem).strip()).strip()
    if fill:
        return stem, "", "fill", "FILL", explanation
    options = {}
    for line in before:
        if re.match(history.OPTION, line):
            for part in re.split(r"(?=[A-J][.、）)])", line):
                if re.match(r"[A-J][.、)]", part.strip()):
                    options.setdefault(part.strip()[0], part.strip()[2:].strip())
    letters = "".join(sorted(re.sub(r"[.。、\s]", "", raw)))
    if sorted(options.values()) == ["正确", "错误"] and letters in ("A", "B"):
        return stem, "AB", "judgement", "A" if options.get(letters, "正确") == "正确" else "B", explanation
    if raw == "对":
        return (stem, "AB", "judgement", "A", explanation) if stem or options else None
    if not re.fullmatch("[A-J]+", letters) or not options or (len(letters) > 1 and not set(letters) <= set(options)):
        return None
    return stem, "".join(options), "single" if len(letters) == 1 else "multi", letters, explanation


def test_equals_a_walk_over_the_lines(spark):
    rng = random.Random(3)
    files = [(f"f{k}", "\n".join(rng.choices(LINES, [1] * 12 + [3] * 15, k=rng.choice((0, 5, 900))))) for k in range(24)]
    files += [("empty", ""), ("none", None), ("unknown", "### 1. a\n**答案：对**")]
    specs = [(f, f"g{f}", f"t{f}", bool(i % 2)) for i, (f, _) in enumerate(files[:-1])]
    lines = markdown.lines_of(spark.createDataFrame(files, "file string, text string"))
    found = history.marked_blocks(lines.repartition(7), spark.createDataFrame(specs, "file string, group string, title string, subsets boolean"))
    got = sorted((r.file, r.group, r.title, r.number, r.stem, "".join(o.key for o in r.options), r.kind, r.answer_key, r.explanation) for r in history.history_questions(found).collect())
    want = []
    for (file, text), (_, group, title, subsets) in zip(files, specs):
        numbers = {}
        for block in walk(text or "", group, title, subsets):
            if (q := question(block)) is not None:
                numbers[block[2]] = numbers.get(block[2], 0) + 1
                want.append((file, block[0], block[1], numbers[block[2]], *q))
    assert {w[6] for w in want} == {"single", "multi", "judgement", "fill"} and len(want) > 100
    assert got == sorted(want)


def test_long_text_and_clashing_columns(spark):
    text = "### 1. " + "词" * 200_000 + "\nA. x\nB. y\n**答案：B**\n**解析：** " + "z" * 200_000
    lines = markdown.lines_of(spark.createDataFrame([("f", text)], "file string, text string")).selectExpr("*", "1 AS base", "'q' AS mark", "0 AS part")
    specs = spark.createDataFrame([("f", "g", "t", None)], "file string, group string, title string, subsets boolean")
    (row,) = history.history_questions(history.marked_blocks(lines, specs)).collect()
    assert (len(row.stem), row.answer_key, row.answer_text, len(row.explanation)) == (200_000, "B", "y", 200_000)
    assert history.history_questions(history.marked_blocks(lines.limit(0), specs)).count() == 0
