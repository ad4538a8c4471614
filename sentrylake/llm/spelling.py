"""Spelling variants: words one edit apart, found without pairs of words.

Words are the runs of letters of all texts, with how often each occurs. Two words are near if one inserted, deleted or
replaced code point makes one the other; a word's form is its near word that occurs most, if it occurs RATIO times as
often as the word itself. The vocabulary is sorted by range, most frequent words first, then by code points; a word's
number in that order stands for it, so that the least number is the best word.

Replacements: a word belongs to one wildcard group for each of its positions, named by the position and what is before
and behind it. All words of a group are near each other, so the group's size and its top two words say all that a
member needs: it is near size - 1 others, the best of which is the first, or the second if the first is the word
itself. A group has no more words than the alphabet has letters. Insertions and deletions: a word's distinct results of
deleting one code point are joined with the vocabulary; a word of n letters finds n words at most. Both give partial
counts and best words, which one grouping by word combines. Rows grow with the letters of the vocabulary, whatever the
words have in common.

Names are sums of 128-bit hashes of (letter, place), which prefix sums give for all positions at once: a word of a
million letters costs a million rows of five numbers, and never a string for each.

Forms occur RATIO times as often from word to form, so chains are short: the last of a chain is found by doubling, in
a number of joins that follows from the largest count.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import prepare, some, stored
from .shingles import M1, M3, U, mix

#: Least code points and least occurrences of a word; how many times as often as the word its form occurs.
LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
LETTERS = r"A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Of the occurrences, that whose check sum this divides loses a code point (see `with_slips`).
SLIPS = 31


def runs(docs: DataFrame, least: int = LEAST_LENGTH, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, run: every maximal run of at least `least` letters, A-Z in lower case. A null text has none."""
    found = F.explode(F.regexp_extract_all(F.col(text), F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0)))
    return docs.select(F.col(doc_id).alias("doc_id"), found.alias("run")).select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))


def with_slips(run: Column, doc_id: Column, every: int = SLIPS) -> Column:
    """The run, or if `every` divides the crc32 h of `doc_id:run`, the run without its code point h % length: slips
    that any reader of the same texts can repeat. A null id counts as an empty text."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(words: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n (how often it occurs) of a column `word` with a row an occurrence."""
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def numbered(vocab: DataFrame) -> DataFrame:
    """id, word, n: ids grow from the most frequent word to the rarest, and with the code points of words of one count."""
    laid = vocab.repartitionByRange(F.desc("n"), F.asc("word")).sortWithinPartitions(F.desc("n"), F.asc("word"))
    return stored(laid.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "numbered")


#: Kinds of names: of a word, of its wildcard groups, of the results of deleting one of its letters.
WORD, GROUP, CUT = 0, 1, 2
LANES = (U(0x9FB21C651E98DF25), U(0xD6E8FEB86659FD93))


def name_words(words: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of every name: the place of its word in `words`, its kind, and its two hashes."""
    sizes = np.array([len(w) for w in words], np.int64)
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), sizes)
    start = np.cumsum(sizes) - sizes
    place = np.arange(len(letters)) - start[owner]
    # a letter that follows its like gives the same word when it goes
    cut = np.flatnonzero((place == 0) | (letters != np.roll(letters, 1)))
    owners = np.concatenate([np.arange(len(words)), owner, owner[cut]])
    kinds = np.repeat(np.array([WORD, GROUP, CUT], np.int8), [len(words), len(letters), len(cut)])
    lanes = []
    for seed in LANES:
        stay = mix(mix(letters * M1 + seed) + place.astype(np.uint64) * M3)
        moved = mix(mix(letters * M1 + seed) + (place - 1).astype(np.uint64) * M3)
        upto, shifted = (np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)]) for x in (stay, moved))
        first, end = start[owner], (start + sizes)[owner]
        whole = upto[start + sizes] - upto[start]
        group = mix(whole[owner] - stay + seed) + mix(place.astype(np.uint64) ^ seed) + mix(sizes[owner].astype(np.uint64) * M1 + seed)
        rest = (upto[:-1] - upto[first]) + (shifted[end] - shifted[1:])
        length = lambda n: mix(n.astype(np.uint64) * M3 + seed)  # noqa: E731, B023
        lanes.append(np.concatenate([whole + length(sizes), group, (rest + length(sizes[owner] - 1))[cut]]).view(np.int64))
    return owners, kinds, lanes


def names(vocab: DataFrame) -> DataFrame:
    """kind, a, b, id, n of a numbered vocabulary's names."""
    prepare(vocab.sparkSession)

    def run(batches):
        for batch in some(batches):
            owners, kinds, (a, b) = name_words(batch.column(1).to_pylist())
            ids, ns = (batch.column(k).to_numpy()[owners] for k in (0, 2))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (kinds, a, b, ids, ns)], ["kind", "a", "b", "id", "n"])

    return vocab.select("id", "word", "n").mapInArrow(run, "kind byte, a long, b long, id long, n long")


def forms(vocab: DataFrame) -> DataFrame:
    """id, n_near, best (id and n of the near word that occurs most) of a numbered vocabulary's words that have one."""
    named = stored(names(vocab), "names")
    me = F.struct("id", "n")
    group = Window.partitionBy("a", "b").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = named.where(F.col("kind") == GROUP).select("id", F.count("*").over(group).alias("size"), F.first(me).over(group).alias("first"), F.nth_value(me, 2).over(group).alias("second"))
    best = F.when(F.col("first.id") == F.col("id"), F.col("second")).otherwise(F.col("first"))
    replaced = rows.where("size > 1").select("id", (F.col("size") - 1).alias("near"), best.alias("best"))
    long_, short = named.where(F.col("kind") == CUT).select("a", "b", me.alias("long")), named.where(F.col("kind") == WORD).select("a", "b", me.alias("short"))
    sides = F.array(F.struct(F.col("short.id").alias("id"), F.col("long").alias("best")), F.struct(F.col("long.id").alias("id"), F.col("short").alias("best")))
    moved = long_.join(short, ["a", "b"]).select(F.explode(sides).alias("s")).select("s.id", F.lit(1).cast("long").alias("near"), "s.best")
    return replaced.unionByName(moved).groupBy("id").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def with_roots(links: DataFrame, most: int, least: int = LEAST_COUNT, ratio: int = RATIO) -> DataFrame:
    """id, form, root of links from id to form. After k joins a word knows what follows after 2^k forms, and no chain
    is longer than counts can grow, by `ratio` from one to the next, from `least` to `most`."""
    depth = 0
    while least * ratio ** (depth + 1) <= most:
        depth += 1
    links = links.select("id", "form", F.col("form").alias("root"))
    for k in range(math.ceil(math.log2(depth)) if depth > 1 else 0):
        links = stored(links, f"roots-{k}")
        after = links.select(F.col("id").alias("root"), F.col("root").alias("next"))
        links = links.join(after, "root", "left").select("id", "form", F.coalesce("next", "root").alias("root"))
    return links


def variants(vocab: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of a vocabulary (word, n)."""
    vocab = numbered(vocab)
    rows = vocab.join(forms(vocab), "id", "left")
    rows = stored(rows.withColumn("form", F.when(F.col("best.n") >= ratio * F.col("n"), F.col("best.id"))), "forms")
    linked = rows.where("form is not null")
    ends = linked.agg(F.max("best.n"), F.min("n")).first()
    links = with_roots(linked, ends[0] or 0, ends[1] or 1, ratio)
    called = lambda name: vocab.select(F.col("id").alias(name), F.col("word").alias(f"{name}_word"), F.col("n").alias(f"{name}_n"))
    links = links.join(called("form"), "form").join(called("root"), "root").select("id", "form_word", "form_n", "root_word")
    out = rows.drop("form").join(links, "id", "left")
    return out.select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n")


def spelling_variants(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", slips: int = SLIPS) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of all texts, after their slips.

    Null and empty texts have no words; a row that repeats another counts again; among words of one count the first
    in code-point order is the form; a table without words gives no rows. Other columns are not read."""
    found = runs(docs, text=text, doc_id=doc_id)
    words = found.select(with_slips(F.col("run"), F.col("doc_id"), slips).alias("word"))
    return variants(stored(vocabulary(words), "vocabulary"))
