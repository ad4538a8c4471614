"""Ranked full text: postings by term in sorted files, and the score of the best field.

A segment holds the postings (term, field, id, times, size) of a batch of rows. Rows are dealt by a hash of their id, and
the postings of each part are sorted by term where they are made, so that no posting is shuffled and a file names few
ids, by a dictionary. A look-up reads the pages whose terms it asks for, by statistics and Bloom filters.
Beside them are the ids of the batch and, per field, how many rows have it and how long they are together. A row that
comes again in a later segment counts there alone.

A hit's score in a field is the sum over the words asked for of BM25, ln(1 + (N - n + 0.5) / (n + 0.5)) * f / (f + K1 (1 -
B + B size / mean size)); its score is that of its best field.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.session import Folder, tidy

#: The usual constants of BM25.
K1, B = 1.2, 0.75
FIELDS = ("summary", "title", "command_line", "log.log_original", "log.log_message")
#: Bytes of a file's dictionary of ids.
DICTIONARY = 16 << 20
POSTINGS = "term string, field string, id string, times long, size long"


def tokens(rows: DataFrame, fields: tuple[str, ...], id_column: str) -> DataFrame:
    """field, id, words of every field that has a word."""
    each = F.array(*(F.struct(F.lit(f).alias("field"), X.search_tokens(F.col(f)).alias("words")) for f in fields))
    out = rows.select(F.col(id_column).cast("string").alias("id"), F.explode(each).alias("f")).select("f.field", "id", "f.words")
    return out.where((F.size("words") > 0) & F.col("id").isNotNull())


class TextIndex:
    """The segments in a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.folder = spark, path.rstrip("/"), Folder(spark, path)

    def add(self, rows: DataFrame, batch: int, fields: tuple[str, ...] = FIELDS, id_column: str = "alert_id") -> None:
        """Index a batch of rows with distinct ids; a batch that comes again replaces its segment. Rows without an id
        aren't indexed."""
        at, found = f"{self.path}/segment={batch:09d}", tokens(rows, fields, id_column)
        ids = rows.select(F.col(id_column).cast("string").alias("id")).where("id is not null")
        with tidy(self.spark):
            self._write_ids(ids, f"{at}/ids")
            size = F.size("words").cast("long")
            found.groupBy("field").agg(F.count("*").alias("n"), F.sum(size).alias("words")).coalesce(1).write.mode("overwrite").parquet(f"{at}/fields")
            texts = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("text")) for f in fields))
            dealt = self._dealt(rows.select(F.col(id_column).cast("string").alias("id"), texts.alias("texts")).where("id is not null"))
            each = dealt.select("id", F.explode("texts").alias("f")).select("id", "f.field", X.search_tokens(F.col("f.text")).alias("words"))
            words = each.select("field", "id", size.alias("size"), F.explode("words").alias("term"))
            postings = words.groupBy("id", "term", "field").agg(F.count("*").alias("times"), F.first("size").alias("size"))  # an id is in one part
            self._write_postings(postings, f"{at}/postings")

    def _dealt(self, rows: DataFrame) -> DataFrame:
        """Rows by a hash of their id, over as many parts as the session shuffles to, however small they are."""
        return rows.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "id")

    def _write_ids(self, ids: DataFrame, path: str) -> None:
        self._dealt(ids).sortWithinPartitions("id").write.mode("overwrite").parquet(path)

    @staticmethod
    def _write_postings(postings: DataFrame, path: str) -> None:
        """In files by term; ids by dictionary also where there are many."""
        rows = postings.select(*(c.split()[0] for c in POSTINGS.split(", "))).sortWithinPartitions("term", "field", "id")
        rows.write.mode("overwrite").option("parquet.bloom.filter.enabled#term", "true").option("parquet.dictionary.page.size", str(DICTIONARY)).parquet(path)

    def segments(self) -> list[str]:
        return [n for n in self.folder.names() if n.startswith("segment=")]

    def table(self, name: str, schema: str) -> DataFrame:
        """A table of all segments, with the number of each."""
        out = self.spark.createDataFrame([], f"{schema}, segment long")
        for s in self.segments():
            out = out.unionByName(self.spark.read.schema(schema).parquet(f"{self.path}/{s}/{name}").withColumn("segment", F.lit(int(s[8:])).cast("long")))
        return out

    def postings(self, terms: list[str]) -> DataFrame:
        """The postings of some terms, of every row the last."""
        found = self.table("postings", POSTINGS).where(F.col("term").isin(terms))
        if len(self.segments()) < 2:
            return found
        last = self.table("ids", "id string").join(found.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.max("segment").alias("segment"))
        return found.join(last, ["id", "segment"], "left_semi")

    def search(self, query: str) -> DataFrame:
        """id, score, field (the best) of the rows that have a word of the query in a field."""
        terms = self.spark.range(1).select(F.array_distinct(X.search_tokens(F.lit(query))).alias("t")).first().t  # the query's words
        fields = self.table("fields", "field string, n long, words long").groupBy("field").agg(F.sum("n").alias("all"), (F.sum("words") / F.sum("n")).alias("mean"))
        found = self.postings(terms)
        often = found.groupBy("field", "term").agg(F.count("*").alias("n"))  # a row a field and word of the query
        rows = found.join(F.broadcast(often), ["field", "term"]).join(F.broadcast(fields), "field")
        rare = F.log(1 + (F.col("all") - F.col("n") + 0.5) / (F.col("n") + 0.5))
        weight = rare * F.col("times") / (F.col("times") + K1 * (1 - B + B * F.col("size") / F.col("mean")))
        by_field = rows.groupBy("id", "field").agg(F.sum(weight).alias("score"))
        best = by_field.groupBy("id").agg(F.max(F.struct("score", "field")).alias("b"))
        return best.select("id", "b.score", "b.field")

    def top(self, query: str, most: int = 20) -> DataFrame:
        """The best hits, of equal ones the first by id."""
        return self.search(query).orderBy(F.desc("score"), "id").limit(most)

    def merge(self) -> None:
        """All segments as one, without what has come again."""
        segments = self.segments()
        if len(segments) < 2:
            return
        last = self.table("ids", "id string").groupBy("id").agg(F.max("segment").alias("segment"))
        left = {r.segment for r in last.select("segment").distinct().collect()}  # at most one a segment
        for s in [s for s in segments if int(s[8:]) not in left and s != segments[-1]]:
            self.folder.delete(s)  # all that it has has come again
        segments = self.segments()
        if len(segments) < 2:
            return
        last = self.table("ids", "id string").groupBy("id").agg(F.max("segment").alias("segment"))
        at = f"{self.path}/_merged"
        self.folder.delete("_merged")
        with tidy(self.spark):
            self._write_ids(last.select("id"), f"{at}/ids")
            held = self.table("postings", POSTINGS).join(last, ["id", "segment"], "left_semi").drop("segment")
            self._write_postings(self._dealt(held), f"{at}/postings")
            sizes = self.spark.read.schema(POSTINGS).parquet(f"{at}/postings").groupBy("field", "id").agg(F.first("size").alias("size"))
            sizes.groupBy("field").agg(F.count("*").alias("n"), F.sum("size").alias("words")).coalesce(1).write.parquet(f"{at}/fields")
        self.folder.move("_merged", f"segment={int(segments[-1][8:]) + 1:09d}")  # counts for all before, which now go
        for s in segments:
            self.folder.delete(s)
