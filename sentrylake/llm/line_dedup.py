"""Line dedup: repeated runs of lines by a suffix array over line ids, DataFrame operations only.

Texts are sequences of their lines that have a word. Lines that occur once end every run, so only the others are
positions of the suffix array. Distributed prefix doubling ranks the positions by their first 1, 2, 4, ... lines: the
ranks of two halves are grouped, the pairs that occur twice or more are sorted by range over the partitions and
numbered in order, and all others leave the next level. A position keeps its ranks of all levels.

The array holds the suffixes where a run of at least `min_words` words can begin, cut to the shortest such run, and
those cut to the shortest run that ends at a position: sorted by range (length, ranks, then place in the corpus),
so that an interval of equal prefixes may span partitions. The longest common prefix of two neighbours reaches the
run's length n where they agree in the ranks of its first and of its last 2^k <= n lines; where it doesn't, an interval
begins. The first row of an interval is the run's first occurrence; it is handed on to the interval's other rows
inside a partition by a window and from partition to partition by a table of one row each. No interval is grouped
in one task.

The others are later copies, and their lines are deleted, but for those that overlap the first occurrence itself: a
line that repeats goes on as far as the first whole run, which stays. The maximal repeated runs are exactly covered
by the shortest ones that begin and end at their positions: a line of a longer run either ends such a run inside it
or is covered by the one that the longer run begins with. So doubling only goes as far as such shortest runs are long
(at most min_words lines).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import stored

MIN_WORDS = 50
WORD = r"[^\x20\x09-\x0D]+"
#: Texts are cut before each line that has a word, so that blank lines stay with the line above them.
CUT = r"\n(?=[\x20\x09\x0B-\x0D]*[^\x20\x09-\x0D])"
LOWEST = -(1 << 63)
DOC = ["k", "t"]


def identity(text: str = "text", doc_id: str = "doc_id") -> list[Column]:
    """A document's place in the order: its id (null first), then a hash of its text."""
    return [F.coalesce(F.col(doc_id).cast("long"), F.lit(LOWEST)).alias("k"), F.xxhash64(F.col(text)).alias("t")]


def word_count(line: Column) -> Column:
    """The words of a line: by its spaces, where they are single and the only white space, else by pattern."""
    t = F.trim(line)
    plain = ~(F.contains(t, F.lit("  ")) | F.contains(t, F.lit("\t")) | F.contains(t, F.lit("\x0b")) | F.contains(t, F.lit("\f")) | F.contains(t, F.lit("\r")))
    return F.when(plain, F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1).otherwise(F.regexp_count(line, F.lit(WORD)))


def count_lines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def positions(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """k, t, pos, a, b (the line's id), words, lines (it and the blank ones below)."""
    rows = docs.where(F.col(text).isNotNull()).select(*identity(text, doc_id), F.posexplode(F.split(text, CUT)).alias("pos", "x"))
    rows = rows.where(F.col("x").rlike(WORD))  # a first piece may be blank
    line = F.substring_index("x", "\n", 1)
    return rows.select(*DOC, "pos", F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"), word_count(line).alias("words"), count_lines(F.col("x")).alias("lines"))


def ranked(pairs: DataFrame, name: str) -> DataFrame:
    """Number distinct (a, b) from 0 in their order: `rank`."""
    laid = stored(pairs.repartitionByRange("a", "b").withColumn("pid", F.spark_partition_id()), name)
    sizes = laid.groupBy("pid").agg(F.count("*").alias("n"))  # one row a partition
    before = sizes.select("pid", (F.sum("n").over(Window.orderBy("pid")) - F.col("n")).alias("before"))
    rank = F.col("before") + F.row_number().over(Window.partitionBy("pid").orderBy("a", "b")) - 1
    return laid.join(F.broadcast(before), "pid").select("a", "b", rank.alias("rank"))


def shortest_runs(rows: DataFrame, min_words: int) -> DataFrame:
    """k, t, first, last of the shortest runs with at least min_words words that begin or end at a position, inside
    stretches of consecutive positions."""
    stretch = F.col("pos") - F.row_number().over(Window.partitionBy(*DOC).orderBy("pos"))
    rows = rows.select(*DOC, "pos", "words", stretch.alias("stretch"))
    upto = F.sum("words").over(Window.partitionBy(*DOC, "stretch").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("words"))
    ahead = Window.partitionBy(*DOC, "stretch").orderBy("before").rangeBetween(0, min_words - 1)
    back = Window.partitionBy(*DOC, "stretch").orderBy("upto").rangeBetween(1 - min_words, 0)
    rows = rows.select(*DOC, "pos", "upto", "before", F.max("pos").over(ahead).alias("last"), F.max("upto").over(ahead).alias("most"), F.min("pos").over(back).alias("first"), F.min("before").over(back).alias("least"))
    begin = F.when(F.col("most") - F.col("before") >= min_words, F.struct(F.col("pos").alias("first"), F.col("last").alias("last")))
    end = F.when(F.col("upto") - F.col("least") >= min_words, F.struct(F.col("first").alias("first"), F.col("pos").alias("last")))
    return rows.select(*DOC, F.explode(F.array_distinct(F.array_compact(F.array(begin, end)))).alias("r")).select(*DOC, "r.first", "r.last")


PREFIX = ["size", "ra", "rb"]


def later_copies(named: DataFrame, rows: int) -> DataFrame:
    """k, t, first, last, origin (k, t, first, last of the first occurrence) of the runs that repeat an earlier one
    without overlapping it; of at most `rows` runs (k, t, first, last, size, ra, rb)."""
    place, prefix = F.struct(*DOC, "first", "last"), F.struct(*PREFIX)
    laid = named.repartitionByRange(*PREFIX, *DOC, "first").withColumn("pid", F.spark_partition_id())
    order = Window.partitionBy("pid").orderBy(*PREFIX, *DOC, "first")
    begins = F.lag(prefix).over(order) != prefix  # null at a partition's first row: its neighbour is elsewhere
    array = laid.withColumn("begins", begins)
    array = array.withColumn("head", F.last(F.when(F.col("begins"), place), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    array = stored(array.drop("begins"), "suffix-array", rows)
    at = F.struct(prefix.alias("prefix"), place.alias("place"), F.col("head"))
    ends = array.groupBy("pid").agg(F.min(at).alias("low"), F.max(at).alias("high"))  # one row a partition
    pids = Window.orderBy("pid")
    ends = ends.withColumn("own", F.when(F.coalesce(F.lag("high.prefix").over(pids) != F.col("low.prefix"), F.lit(True)), F.col("low.place")))
    before = F.last(F.coalesce("high.head", "own"), ignorenulls=True).over(pids.rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select("pid", F.coalesce("own", before).alias("entry"))
    array = array.join(F.broadcast(ends), "pid").withColumn("origin", F.coalesce("head", "entry"))
    overlaps = (F.col("k") == F.col("origin.k")) & (F.col("t") == F.col("origin.t")) & (F.col("first") <= F.col("origin.last"))
    return array.where((place != F.col("origin")) & ~overlaps).select(*DOC, "first", "last", "origin")


def copied_lines(docs: DataFrame, min_words: int = MIN_WORDS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """k, t, gone (sorted positions to delete), lines and words (how many they hold), sources (ids of the documents with the
    first copies)."""
    lines = stored(positions(docs, text, doc_id).distinct(), "lines")
    n = lines.count()  # no table below has more rows, but `runs` twice as many
    often = lines.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").select("a", "b")
    level = lines.join(ranked(often, "ranks"), ["a", "b"]).select(*DOC, "pos", "lines", "words", F.array("rank").alias("r"))
    level = stored(level, "level-0", n)
    runs = stored(shortest_runs(level, min_words), "runs", 2 * n)
    longest = runs.agg(F.max(F.col("last") - F.col("first") + 1)).first()[0] or 1
    for k in range(int(math.log2(longest))):
        there = F.max(F.get("r", F.lit(k))).over(Window.partitionBy(*DOC).orderBy("pos").rangeBetween(1 << k, 1 << k))
        halves = stored(level.withColumn("a", F.get("r", F.lit(k))).withColumn("b", there), f"halves-{k}", n)
        often = halves.where("a is not null and b is not null").groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").select("a", "b")
        level = stored(halves.join(ranked(often, f"ranks-{k}"), ["a", "b"], "left").select(*DOC, "pos", "lines", "words", F.concat("r", F.array("rank")).alias("r")), f"level-{k + 1}", n)
    # a run's name: its length and the ranks of its first and last 2^k lines
    size = F.col("last") - F.col("first") + 1
    k = F.floor(F.log2(size.cast("double"))).cast("int")
    named = runs.withColumn("size", size).withColumn("lg", k).withColumn("tail", F.col("last") - F.expr("shiftleft(1, lg)") + 1)
    ranks = level.select(*DOC, "pos", "r")
    named = named.join(ranks.withColumnRenamed("pos", "first").withColumnRenamed("r", "ra"), [*DOC, "first"]).join(ranks.withColumnRenamed("pos", "tail").withColumnRenamed("r", "rb"), [*DOC, "tail"])
    named = named.select(*DOC, "first", "last", "size", F.get("ra", "lg").alias("ra"), F.get("rb", "lg").alias("rb")).where("ra is not null and rb is not null")
    later = later_copies(named, 2 * n)
    gone = later.select(*DOC, F.col("origin.k").alias("source"), F.explode(F.sequence("first", "last")).alias("pos"))
    gone = gone.groupBy(*DOC, "pos").agg(F.min("source").alias("source"))
    gone = gone.join(level.select(*DOC, "pos", "lines", "words"), [*DOC, "pos"])
    gone = gone.groupBy(*DOC).agg(F.array_sort(F.collect_list("pos")).alias("gone"), F.sum("lines").alias("lines"), F.sum("words").alias("words"), F.array_sort(F.collect_set("source")).alias("sources"))
    return stored(gone, "gone", n)


def without_copies(docs: DataFrame, min_words: int = MIN_WORDS, report: bool = False) -> DataFrame:
    """The documents with `text` freed of later copies; with `report` also a struct `report` of n_lines, deleted_lines,
    deleted_words and copied_from. All other columns keep their values, whatever they are called.

    A text that consists of later copies becomes empty; blank lines go with the line above them. Null and empty texts
    stay as they are. Rows that repeat both id and text are one document and get the same result; rows of one id with
    other texts are ordered by a hash of the text. An empty table gives no rows."""
    k, t = identity()
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in others)).alias("row"), k, t, count_lines(F.col("text")).alias("n"), F.split("text", CUT).alias("pieces"))
    # the same plan at every size; only the short side is held, by partition
    rows = rows.join(copied_lines(docs, min_words).hint("shuffle_hash"), DOC, "left")
    # the pieces are a column by now: looked up by number, not split again for each
    kept = F.array_except(F.sequence(F.lit(0), F.size("pieces") - 1), F.col("gone"))
    pieces = F.when(F.col("gone").isNull(), F.col("pieces")).otherwise(F.transform(kept, lambda i: F.get("pieces", i)))
    text = F.array_join(pieces, "\n")
    out = [text.alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns]
    if report:
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
        found = {"n_lines": zero("n"), "deleted_lines": zero("lines"), "deleted_words": zero("words"), "copied_from": F.coalesce("sources", F.array().cast("array<bigint>"))}
        out.append(F.struct(*(c.alias(name) for name, c in found.items())).alias("report"))
    return rows.select(*out)


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_lines, deleted_lines, deleted_words, copied_from (ids of documents with first copies), text."""
    return without_copies(docs.select("doc_id", "text"), min_words, report=True).select("doc_id", "report.*", "text")
