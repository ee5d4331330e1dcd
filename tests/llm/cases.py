"""Small documents that every operator must take: nulls, empty and long texts, ties, repeated rows."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, _key long, _sha string, score double"
WORDS = "ala bel cor dun eri fos gam hul ist jor kel lum mon nar ost pel qui ras sul tov".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


def edge_rows() -> list[tuple]:
    """(doc_id, text) pairs."""
    long_text = prose(1, 30_000)
    near = prose(2, 300).split()
    near[150] = "changed"
    return [
        (1, None), (2, ""), (3, " \t\n"), (4, "word"), (5, "two words"), (6, prose(2, 300)), (7, " ".join(near)),
        (8, prose(2, 300)), (8, prose(2, 300)),  # a repeated row
        (9, prose(3, 50)), (9, prose(4, 50)),  # two texts under one id
        (None, prose(5, 40)), (None, None), (10, long_text), (11, long_text + " tail"),
        (12, "na " * 400), (13, "1234 !!"), (14, "Ünïcode    wörds — \U0001f600 " * 3), (15, "a\u0000b\x0bc  d"),
        (16, prose(6, 20) + " " + prose(7, 60)), (17, prose(8, 20) + " " + prose(7, 60)),
    ]


def frame(spark, rows=None):
    rows = edge_rows() if rows is None else rows
    full = [(i, t, "aa" if (i or 0) % 2 else "bb", None, None if t is None else len(t), "r", 7, "s", 0.25) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


def random_rows(seed: int, n: int) -> list[tuple]:
    """Documents with copies, near copies and shared passages."""
    rng = random.Random(seed)
    shared = prose(seed + 1000, 45)
    rows = []
    for i in range(n):
        kind = rng.random()
        if rows and kind < 0.2:
            text = rng.choice(rows)[1]
        elif rows and kind < 0.45:
            w = rng.choice(rows)[1].split(" ")
            for _ in range(rng.randint(1, 3)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            text = " ".join(w)
        else:
            text = prose(rng.randrange(1 << 30), rng.randint(1, 120))
            if kind > 0.8:
                text += " " + shared
        rows.append((i, text))
    return rows
