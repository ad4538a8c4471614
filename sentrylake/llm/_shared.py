"""What the operators share: shipping the package, scratch tables, streamed groups, block pairs."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a batch that a worker turns into Python objects at once (Spark itself bounds a batch in bytes).
SOME = 512


def prepare(spark: SparkSession) -> None:
    """Make the package importable in Python workers (once per context). No setting of the session is changed."""
    sc = spark.sparkContext
    if not getattr(sc, "_sentrylake_shipped", False):
        root = Path(__file__).resolve().parents[1]
        target = Path(tempfile.mkdtemp()) / "sentrylake.zip"
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(str(target))
        sc._sentrylake_shipped = True


def some(batches):
    """Arrow batches in slices of at most SOME rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, SOME):
            yield batch.slice(at, SOME)


#: Paths of scratch tables, in the order of their making.
_written: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that spark.checkpoint.dir names (where it is unset: in the warehouse, shared too)."""
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    base = re.sub(r"^file:/(?!/)", "file:///", base)
    _written.append(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _written[-1]


@contextmanager
def released(spark: SparkSession):
    """Deletes the scratch tables made inside, but the one that was made last: a result that is stored needs no other."""
    start = len(_written)
    yield
    gone, _written[start:] = _written[start:-1], _written[-1:] if len(_written) > start else []
    for path in gone:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Narrow rows that a file of a short table holds.
FILE_ROWS = 250_000


def stored(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Cut the lineage: write `df` to the shared folder and read it back. `rows`: a bound on the rows of a narrow
    table, which is then written in as few tasks and files as that asks for."""
    spark = df.sparkSession
    path = scratch(spark, name)
    if rows is not None and (files := rows // FILE_ROWS + 1) < 8:
        df = df.coalesce(files)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(name: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def in_fold(modulus: int, remainder: int, name: str = "doc_id") -> Column:
    """Whether crc32(id as text) mod `modulus` is `remainder`; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def small_join(left: DataFrame, right: DataFrame, on: list[str], rows: int, most: int = 20_000, how: str = "left") -> DataFrame:
    """Join with a table of `rows` rows: broadcast up to `most` rows, else an ordinary join that adaptive execution can split."""
    return left.join(F.broadcast(right) if rows <= most else right, on, how)


def groups(batches, key: str):
    """Of Arrow batches sorted by `key`: each group as one table, also where it spans batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(k[1:] != k[:-1]) + 1
        at = 0
        if held and held[-1].column(held[-1].schema.get_field_index(key))[-1].as_py() != k[0]:
            yield pa.Table.from_batches(held)
            held = []
        for c in cuts:
            held.append(batch.slice(at, c - at))
            yield pa.Table.from_batches(held)
            held, at = [], c
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def block_pairs(df: DataFrame, group: str, blocks: Column, member: str) -> DataFrame:
    """Adds `part`, `block` and `own`: rows of a group of one block share one part. Groups of n blocks are cut by a hash
    of `member`; a row goes to the n parts that pair its block with each other block, so that every pair of rows meets
    in exactly one part (pairs inside a block: in the part of the block with itself) and no part holds more than about
    two blocks."""
    mine = F.pmod(F.xxhash64(F.col(member), F.lit(11)), F.col("_n")).cast("int")
    out = df.withColumn("_n", F.greatest(blocks.cast("int"), F.lit(1)))
    out = out.withColumn("block", mine).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    low, high = F.least("block", "_o"), F.greatest("block", "_o")
    return out.withColumn("part", F.xxhash64(F.col(group), low, high)).withColumn("own", low == high).drop("_n", "_o")


def regrouped(df: DataFrame, key: str) -> DataFrame:
    """Grouped rows with their key made anew: a join by it shuffles both sides for itself, and adaptive execution can
    split a key that holds many rows (it can't where the join shares the shuffle of the grouping)."""
    return df.withColumn(key, F.col(key).bitwiseXOR(F.lit(0).cast("long")))


#: Edges of a list whose components one task finds; a longer list is joined step by step.
SHORT = 20_000


def joined_ends(batches):
    """node, root of the edges of Arrow batches (a, b)."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = top(a), top(b)
            root[max(a, b)] = min(a, b)
    nodes = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(x) for x in nodes], pa.int64())], ["node", "root"])


def components(edges: DataFrame, name: str, rows: int, most: int = 60) -> DataFrame:
    """Connected components of at most `rows` undirected edges (a long, b long): (node, root), root the smallest node.

    Up to SHORT edges are one task's, as each step of the others takes eight shuffles, whose tasks the driver keeps in
    mind. Else alternating large-star and small-star steps, each a grouping and a join; a node's neighbours are never
    gathered in one row, and a hub's rows can be split. Stops when the edges no longer change."""
    if rows <= SHORT:
        prepare(edges.sparkSession)
        return edges.where("a <> b").select("a", "b").coalesce(1).mapInArrow(joined_ends, "node long, root long")
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name, rows)
    mark = None
    for _ in range(most):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(regrouped(low, "a"), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(regrouped(low, "a"), "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = stored(small.select("e.*").where("a <> b").distinct(), name, 2 * (mark[0] if mark else rows))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return roots.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


LONG, STRING, BINARY, DOUBLE = T.LongType(), T.StringType(), T.BinaryType(), T.DoubleType()
