"""Commits: what a run wrote becomes the state by one small file, written last.

Layout under a root::

    attempt=<random>/<part>/...      tables of one attempt, whole or not
    _commits/<time>.<batch>.json     names the attempt that is the state of that time

An attempt without a commit is never read, so a run may die between any two writes and be
started again.  A commit appears at once, by a rename, and is never replaced.  It may name the
stream batch it took; a batch that is found here is done.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType

FOLDER = "_commits"
LANDINGS = "landings"
LANDING = StructType([StructField("landing", StringType())])


def folder(spark: SparkSession, path: str):
    """The folder on whatever file system it lives, through Hadoop's own client."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, files = folder(spark, path)
    return files.exists(at)


def names(spark: SparkSession, path: str) -> list[str]:
    at, files = folder(spark, path)
    return [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []


@dataclass(frozen=True, order=True)
class Commit:
    time: int
    batch: str  # '' for a run
    root: str

    @property
    def file(self) -> str:
        return f"{self.root}/{FOLDER}/{self.time:020d}.{self.batch}.json"

    def attempt(self, spark: SparkSession) -> str:
        """Name of the attempt's folder."""
        return json.loads(spark.read.text(self.file, wholetext=True).first().value)["attempt"]

    def part(self, spark: SparkSession, part: str) -> str:
        return f"{self.root}/{self.attempt(spark)}/{part}"


def commits(spark: SparkSession, root: str) -> list[Commit]:
    """All commits, oldest first; only names are listed."""
    found = []
    for name in names(spark, f"{root}/{FOLDER}"):
        if name.endswith(".json") and not name.startswith((".", "_")):
            time, batch = name.removesuffix(".json").split(".", 1)
            found.append(Commit(int(time), batch, root))
    return sorted(found)


def newest(spark: SparkSession, root: str) -> Commit | None:
    return next(reversed(commits(spark, root)), None)


def new_attempt() -> str:
    return f"attempt={uuid.uuid4().hex}"


def commit(spark: SparkSession, root: str, attempt: str, time: int, batch: str = "") -> Commit:
    """Make a finished attempt the state of ``time``; refuses a time or a batch that is taken."""
    done = Commit(time, batch, root)
    for other in commits(spark, root):
        if other.time == time or (batch and other.batch == batch):
            raise FileExistsError(other.file)
    draft, files = folder(spark, f"{root}/{FOLDER}/.{uuid.uuid4().hex}")
    out = files.create(draft)
    out.write(json.dumps({"attempt": attempt, "time": time, "batch": batch}).encode())
    out.close()
    if not files.rename(draft, folder(spark, done.file)[0]):
        raise FileExistsError(done.file)
    return done


def write_buckets(df: DataFrame, root: str, attempt: str, part: str, key: str, buckets: int) -> DataFrame:
    """A part in so many files, one per bucket of ``key``; the part read back.

    ``key`` has to be spread evenly, as a hash is.
    """
    path = f"{root}/{attempt}/{part}-{buckets}"
    name = f"{part}_{uuid.uuid4().hex}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return _only_read(df.sparkSession, name)


def read_buckets(done: Commit, spark: SparkSession, part: str, schema: StructType, key: str) -> DataFrame:
    """A part written by ``write_buckets``, whose joins on ``key`` need no shuffle."""
    attempt = f"{done.root}/{done.attempt(spark)}"
    found = next(n for n in names(spark, attempt) if n.startswith(f"{part}-"))
    name = f"{part}_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    buckets = int(found.rsplit("-", 1)[1])
    path = f"{attempt}/{found}".replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING parquet OPTIONS (path '{path}') "
        f"CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS"
    )
    return _only_read(spark, name)


def _only_read(spark: SparkSession, name: str) -> DataFrame:
    """A table's rows, after its entry is taken from the catalog; its files belong to the attempt and stay."""
    rows = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return rows


def write_part(df: DataFrame, root: str, attempt: str, part: str) -> str:
    path = f"{root}/{attempt}/{part}"
    df.write.parquet(path)
    return path


# -- the ledger of consumed landings --------------------------------------------------


def consumed(spark: SparkSession, root: str) -> DataFrame:
    """``landing`` of every file that a committed attempt took."""
    paths = [f"{c.part(spark, LANDINGS)}" for c in commits(spark, root)]
    paths = [p for p in paths if exists(spark, p)]
    if not paths:
        return spark.createDataFrame([], LANDING)
    return spark.read.schema(LANDING).parquet(*paths)


def new_landings(spark: SparkSession, path: str, root: str) -> DataFrame:
    """``path, landing`` of the files under ``path`` that no commit of ``root`` took.

    Only names are listed, no file is opened.  A file is known by its name, so it doesn't
    matter when a response says it was fetched, or when it landed.
    """
    listed = spark.read.format("binaryFile").load(path).selectExpr("path", "_metadata.file_path as landing")
    return listed.join(consumed(spark, root), "landing", "left_anti")
