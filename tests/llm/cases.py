"""Rows that every operator has to take: nulls in any column, empty and long texts, ties, repeats, clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string, node int, part int, k int, t int, bucket int, key int, __d int, __k string, __t string, __n string, __s string, __x string, row string, pieces string, stats string"
CLASH = ("x", "y", 1, 2, 3, 4, 5, 6, 7, "k", "t", "n", "s", "x", "r", "p", "st")


def words(n, seed, kinds=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))


def rows():
    out = [(i, words(60 + i, i), ("en", "de", None)[i % 3], ("s0", "s1", None)[i % 3]) for i in range(30)]
    out += [(40, None, "en", "s0"), (41, "", "en", "s0"), (42, " \n\t ", None, None), (43, "one", "en", "s0"), (44, "Ünï cödé – 中文 😀 don't", "de", "s1"), (None, words(80, 99), "en", "s0"), (None, None, None, None)]
    out += [(45, words(30_000, 7, 5000), "en", "s0"), (46, "z" * 70_000, "en", "s0"), (47, words(60, 3), "en", "s1"), (48, words(60, 3), "en", "s1")]
    out += [(49, words(70, 5), "en", "s0")] * 3
    return [(i, t, lang, s, len(t or ""), *CLASH) for i, t, lang, s in out]


def frame(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def same_extras(before, after, every=True):
    """The rows of `after` have the columns and types of `before`, and the values of all columns but the text."""
    assert after.dtypes == before.dtypes
    names = [c for c in before.columns if c not in ("text", "n_chars")]
    a, b = (sorted((tuple(r) for r in d.select(*names).collect()), key=str) for d in (before, after))
    assert a == b if every else set(b) <= set(a)
