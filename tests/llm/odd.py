"""Awkward rows that every operator must take."""

import random

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, size int, score string, n_words string, copies int, "
          "kept string, uid int, _d string, shard string, start int")


def words(n, seed=0):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghij", k=r.randint(2, 9))) for _ in range(n))


def rows():
    long = words(20_000, 1)
    body = words(80, 2)
    near = body.split()
    near[40] = "other"
    texts = [(1, body), (2, " ".join(near)), (3, body), (3, body), (3, words(30, 3)), (None, words(40, 4)), (None, None), (4, None), (5, ""),
             (6, " \t\n "), (7, "one"), (8, "one two three"), (9, "ONE two\x0bthree"), (10, long), (11, long + " end"),
             (12, "naïve Ünïcode   words 漢字 é <|endoftext|> it's don't 1234 ..."), (-5, words(25, 5)), (2**62, "x" * 100_000)]
    return [(d, t, "en" if i % 3 else None, ["a", "b", None][i % 3], None, i, "s", "w", 1, "k", 2, "d", "q", 3) for i, (d, t) in enumerate(texts)]


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def none(spark):
    return spark.createDataFrame([], SCHEMA)
