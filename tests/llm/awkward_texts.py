"""Texts with everything that goes wrong in texts."""

import random

AWKWARD = ("doc_id long, text string, lang string, source string, n_chars long, _row string, _text string, row long, hits string, part int, "
           "`group` string, text_key string, score double, size string, `_doc` int, `_key` string")
VOCABULARY = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) + r.choice(["", "", "s", "ed", ",", "."]) + str(r.randint(0, 99)) for _ in range(n))


def awkward_texts() -> list[tuple]:
    """(doc_id, text): nulls, empty and odd texts, copies, near copies, shared passages, a very long text, repeated rows."""
    passage, other = prose(1, 70), prose(2, 49)
    base = prose(3, 120)
    near = base.split()
    near[60] = "changed"
    rows = [
        (1, base), (2, base), (3, " ".join(near)), (4, base.upper()), (5, None), (6, ""), (7, "   \n\t "), (8, "!!! ???"),
        (9, "one"), (10, "one two three"), (10, "one two three"), (None, base), (None, None), (None, prose(4, 60)),
        (11, f"{prose(5, 30)} {passage} {prose(6, 20)}"), (12, f"{passage}\n{prose(7, 10)}"), (13, f"{prose(8, 5)} {passage} {passage}"),
        (14, other), (15, other), (16, prose(9, 50)), (17, prose(9, 50)), (18, "repeat " * 200), (19, "repeat " * 120),
        (20, prose(10, 40_000)), (21, "x" * 300_000), (22, "été ÉTÉ Straße naïve 東京 語\x00 \x1c\xa0tail"), (23, prose(3, 119)),
        (24, base), (24, prose(11, 55)), (24, prose(11, 55)), (-5, passage), (25, "a\n" * 30 + base)]
    return rows
