"""Tables that plans keep in the folder which driver and executors share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> None:
    """Maps keep the last of equal keys; times are UTC. A session that says otherwise can't give the right rows."""
    for key, value in (("spark.sql.mapKeyDedupPolicy", "LAST_WIN"), ("spark.sql.session.timeZone", "UTC")):
        if spark.conf.get(key) != value:
            spark.conf.set(key, value)


#: Paths of scratch tables, in the order of their making.
_written: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir (where it is unset: in the warehouse, which a cluster shares)."""
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    base = re.sub(r"^file:/(?!/)", "file:///", base)
    _written.append(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _written[-1]


#: Shuffle files of an execution go when it ends, not when the driver's collector finds them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Writes inside leave no shuffle files: for tables that are made once and not from rows that are run again."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back."""
    path = scratch(df.sparkSession, name)
    with tidy(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What `make` gives, written and read back as by `stored`; the tables that it stores on its way are deleted then. An
    enclosing `released` leaves it."""
    path = scratch(spark, name)
    _written.remove(path)
    with released(spark):
        df = make()
        with tidy(spark):
            df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Deletes the scratch tables made inside, also when it fails: what comes of them must be written elsewhere by then."""
    start = len(_written)
    try:
        yield
    finally:
        gone = _written[start:]
        del _written[start:]
        for path in gone:
            parent, _, name = path.rpartition("/")
            Folder(spark, parent).delete(name)


class Folder:
    """A folder by Hadoop's file system: local, HDFS or object store alike."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark.sparkContext._jvm, path.rstrip("/")
        self.fs = self.at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, under: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.at(under))) if self.fs.exists(self.at(under)) else []

    def read(self, name: str) -> str:
        source = self.fs.open(self.at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        finally:
            source.close()

    def _whole(self, text: str):
        """A new file of its own name."""
        new = self.at(f"_{uuid.uuid4().hex}.new")
        out = self.fs.create(new, False)
        out.write(bytearray(text.encode()))
        out.close()
        return new

    def create(self, name: str, text: str) -> bool:
        """The file appears whole under a name that none has, or not at all (False): of several writers one succeeds.
        Local folders link the name to the finished file, others rename it, which fails where the name is taken."""
        if self.fs.exists(self.at(name)):
            return False
        new = self._whole(text)
        try:
            if self.fs.getUri().getScheme() != "file":
                return self.fs.rename(new, self.at(name))
            path = lambda p: self.jvm.java.io.File(p.toUri().getPath()).toPath()
            self.jvm.java.nio.file.Files.createLink(path(self.at(name)), path(new))
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" in str(e.java_exception):
                return False
            raise
        finally:
            self.fs.delete(new, False)

    def replace(self, name: str, text: str) -> None:
        """The file under this name becomes another; a reader finds the one or the other."""
        new, files = self._whole(text), self.jvm.org.apache.hadoop.fs
        if not self.fs.rename(new, self.at(name)):  # some file systems don't rename onto a file unless asked to
            kinds = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
            kinds[0] = getattr(files, "Options$Rename").OVERWRITE
            files.FileContext.getFileContext(self.fs.getUri()).rename(new, self.at(name), kinds)

    def move(self, source: str, target: str) -> None:
        """Give a folder another name."""
        self.fs.mkdirs(self.at(target).getParent())
        if not self.fs.rename(self.at(source), self.at(target)):
            raise OSError(f"{self.path}/{source} could not be moved")

    def publish(self, name: str, text: str) -> None:
        """The file's next version, `name-<number>`, appears whole or not at all; readers take the last (`latest`), so
        none ever finds the file gone. All but the last two versions go."""
        versions = self.versions(name)
        number = int(versions[-1].rpartition("-")[2]) + 1 if versions else 1
        while not self.create(f"{name}-{number:012d}", text):
            number += 1
        for old in self.versions(name)[:-2]:
            self.delete(old)

    def versions(self, name: str) -> list[str]:
        return [n for n in self.names() if n.rpartition("-")[0] == name and n.rpartition("-")[2].isdigit()]

    def latest(self, name: str) -> str | None:
        """The text of the last version; None where there is none."""
        versions = self.versions(name)
        return self.read(versions[-1]) if versions else None

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.at(name))

    def age(self, name: str) -> int:
        """Milliseconds since it was written; 0 where it is gone."""
        if not self.exists(name):
            return 0
        return self.jvm.System.currentTimeMillis() - self.fs.getFileStatus(self.at(name)).getModificationTime()

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), True)
