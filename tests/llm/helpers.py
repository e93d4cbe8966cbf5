"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, words string, lines string, h1 long, score double"
WORDS = "the and attion thed anea eriner thanea whst ble tionly hein sh ou of ti nt er on at in".split()


def prose(seed: int, n: int) -> str:
    out, x = [], seed * 7919 + 13
    for i in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[x % len(WORDS)] + WORDS[(x >> 8) % len(WORDS)] + ("." if i % 9 == 8 else "") + ("\n" if i % 18 == 17 else ""))
    return " ".join(out).replace("\n ", "\n")


def rows() -> list[tuple]:
    long = prose(1, 3000)
    near = prose(2, 400).split(" ")
    copies = [" ".join([*near[:k], "changed", *near[k + 1 :]]) for k in (5, 120, 300)]
    texts = [
        (0, prose(3, 60)), (1, None), (2, ""), (3, "   "), (4, "one two"), (5, "one two"), (6, long), (7, " ".join(near)), (8, copies[0]), (9, copies[1]), (10, copies[2]), (11, prose(3, 60)),
        (12, "Tab\there  double  spaces <|endoftext|> naïve ﬁ 你好 don't 12,345"), (13, prose(4, 50) + "\n" + prose(5, 70) + "\n" + prose(6, 30)), (14, prose(7, 40) + "\n" + prose(5, 70)), (15, "x"),
        (16, "Licensed under the Apache License, Version 2.0.\n" + prose(8, 30)), (17, "A\n" * 60), (18, prose(9, 2000)), (18, prose(9, 2000)), (None, prose(10, 30)),
    ]
    return [(i, t, "en", "s", len(t or ""), "clash", "clash", 1, 0.5) for i, t in texts]


def documents(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCS)
