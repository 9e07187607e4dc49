"""Line classifiers and the candidate join against plain counterparts."""

import random

from lexmill.llm import scan_repair

VOCABULARY = "every warm root often steadies bitter chill before evening meal while mother strength throughout harvest complexion gathers another morning powder softens vessel".split()


def sentences(dice, n):
    return " ".join(" ".join(dice.choice(VOCABULARY) for _ in range(dice.randrange(6, 14))).capitalize() + "." for _ in range(n))


def wrapped(text, width):
    rows, row = [], ""
    for w in text.split():
        if row and len(row) + 1 + len(w) > width:
            rows.append(row)
            row = w
        else:
            row = f"{row} {w}".strip()
    return [*rows, row]


def test_breaks_of_pages_and_of_texts():
    """Fitted on texts without pages, tried on pages of other widths: nearly every break is told."""
    dice = random.Random(4)
    reflowed = ["\n".join(sentences(dice, 4) for _ in range(4)) for _ in range(60)] + ["\n".join(f"{k}. {sentences(dice, 2)}" for k in range(1, 7)) for _ in range(40)]
    model = scan_repair.fitted_lines_that_go_on(reflowed)
    right = total = 0
    for width in (44, 52, 66):
        for marks in (False, True):
            for _ in range(20):
                parts = [(f"{k}. " if marks else "") + sentences(dice, 3) for k in range(1, 5)]
                lines = [line for p in parts for line in wrapped(p, width)]
                got = scan_repair.paragraphs(lines, model)
                total += len(lines) - 1
                want = {sum(len(p) + 1 for p in parts[:k]) for k in range(1, len(parts))}
                breaks = {i + 1 for i, c in enumerate(got.replace("\n\n", "\n")) if c == "\n"}
                right += len(lines) - 1 - len(want ^ breaks)
    assert right >= 0.93 * total


def test_furniture_by_where_it_stands():
    """Labels come from repeated patterns between different neighbours that cut sentences; titles and page shapes are what is learned from them."""
    dice = random.Random(7)
    sample = []
    for i in range(120):
        lines = wrapped(sentences(dice, 8), 50)
        if i % 3 == 0:
            lines.insert(3, f"{100 + i} BLUE RIVER")
        if i % 3 == 1:
            lines.insert(4, f"- {300 + i} -")
        if i % 4 == 0:
            lines[-1:] = ["The end of it is near."]
        sample.append(("blue-river-vol1", "\n".join(lines)))
    certain = scan_repair.certain_lines(sample)
    assert certain["# BLUE RIVER"] is True and certain["- # -"] is True and certain.get("The end of it is near.") is not True
    model = scan_repair.Lines.fitted(sample)
    long = sentences(dice, 1)
    for line, want in ((f"77 BLUE RIVER", ("header", "page_no")), ("BLUE R1VER", ("header",)), ("- 41 -", ("page_no",)), (f"Chapter IV of the Blue River says that {long}", ()), (long, ())):
        assert model.kinds(line, "the warm root of", "this bitter chill", ("blue", "river"), 50) == want, line
    # A head longer than any line of a page, in a text without breaks, and one on a short line with other words.
    text, kinds = scan_repair.structure("the root 12 BLUE RIVER of it", "blue-river-vol1", model)
    assert kinds == {"header"} and "BLUE" not in text


def test_candidates_against_all_pairs(spark):
    dice = random.Random(9)
    words = list({"".join(dice.choice("aeioubcdgklmnrst") for _ in range(dice.randrange(2, 12))) for _ in range(160)})
    rows = [(w, dice.randrange(12, 4000)) for w in words]
    tokens = [("".join(dice.choice("aeiou1@") if dice.random() < 0.15 else c for c in w) + dice.choice(["", "", "s"]), dice.randrange(1, 60)) for w in words] + rows + [("x" * 60, 1)]
    tokens = list(dict(tokens).items())
    got = {(r.key, r.word): r.shared for r in scan_repair.similar_words(spark.createDataFrame(tokens, "key string, n long"), spark.createDataFrame(rows, "word string, word_n long")).collect()}
    want = {}
    for t, n in tokens:
        for w, m in rows:
            shared = len(set(scan_repair._grams(t)) & set(scan_repair._grams(w)))
            need = max(2, -int(-(len(w) + 1) * scan_repair.LIKE // 1))
            if m >= scan_repair.RATIO * n and abs(len(t) - len(w)) <= scan_repair.FAR and shared >= need:
                want[t, w] = shared
    assert got == want and len(want) > 100
