"""Word expressions, shared-folder tables and connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager, contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
NOT_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else. Texts of ASCII alone take the quick built-in."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def space_words(text: Column) -> Column:
    """The words between runs of ASCII white space; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def aside(df: DataFrame, *used: str) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """df with its columns other than `used` under names that clash with none of an operator's, and what gives a DataFrame
    that has them df's columns, names and order back, without any others."""
    names = {c: c if c in used else f"kept{i}" for i, c in enumerate(df.columns)}
    back = [F.col(new).alias(c) for c, new in names.items()]
    return df.toDF(*names.values()), lambda out, *more: out.select(*back, *more)


def own_names(df: DataFrame) -> DataFrame:
    """df without columns whose names begin with an underscore: those are the operators' own while they work."""
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def merged(df: DataFrame) -> DataFrame:
    """df as a side of a join that is merged at any size. Tables that grow with the documents are not to be gathered on the
    driver: Spark would broadcast them by the size of their files or shuffled rows, a fourth or less of what the driver holds then."""
    return df.hint("merge")


def alnum_words(text: Column) -> Column:
    """Lower-cased runs of letters, digits and all that is not ASCII; none for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_ALNUM), "")


def count_alnum_words(text: Column) -> Column:
    """size(alnum_words(text)), without lower-casing. Splitting takes a tenth of the time that counting matches does."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), "")).cast("long")


def shingle_hashes(hashes: Column, k: int) -> Column:
    """From an array of word hashes, one 64-bit hash for each k consecutive ones."""
    return F.when(
        F.size(hashes) >= k,
        F.transform(F.sequence(F.lit(0), F.size(hashes) - k), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(k)])),
    ).otherwise(F.array().cast("array<bigint>"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session. Where it is unset, as in
    tests, a local session gets a temporary one; a cluster without it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="quadmill-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """The session's setting `name` is value within it, for what is run and not only planned there."""
    given = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if given is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, given)


#: Shuffle files go as soon as the write that made them has ended, not when the driver's JVM collects its garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_made: ContextVar[list | None] = ContextVar("scratch", default=None)
_left: list["Scratch"] = []


class Scratch:
    """Tables of one run in the shared folder. They cut lineage and outlive executors. What an operator returns may read
    them, so they stay until the caller's cleared() ends, or else until the driver's Python does."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        made = _made.get()
        (_left if made is None else made).append(self)

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        with setting(self.spark, SHUFFLE_CLEANUP, "true"):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def _delete(self, where: str) -> None:
        path = self._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(self._conf).delete(path, True)

    def drop(self, df: DataFrame) -> None:
        self._delete(df.scratch_path)

    def clear(self) -> None:
        self._delete(self.root)


@atexit.register
def _clear_left() -> None:
    for s in _left:
        try:
            s.clear()
        except Exception:  # the JVM has gone before
            return


@contextmanager
def cleared() -> Iterator[None]:
    """Removes at its end all tables that operators made within it: write what they return before."""
    token = _made.set([])
    try:
        yield
    finally:
        for s in _made.get():
            s.clear()
        _made.reset(token)


#: Rows that a Python worker gets at once where texts go to Python; they may be long.
BATCH = 1_000
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> AbstractContextManager[None]:
    """Python workers get BATCH rows at once, for what is run and not only planned within it."""
    return setting(spark, BATCH_SETTING, str(BATCH))


def _are_stars(edges: DataFrame) -> bool:
    """Whether every a has one b and no b is an a."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of edges (a, b): root is the component's smallest node.

    Alternates large-star and small-star steps, each a min per node joined back, until every node points straight at its
    root. Rounds grow with the logarithm of the longest chain; edges stay distributed.
    """
    now = scratch.save(edges.where("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct())
    rounds = 0
    while not _are_stars(now):
        if rounds == max_rounds:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        rounds += 1
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(merged(least), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(merged(least), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = scratch.save(small.union(least.select("a", F.col("m").alias("b"))).distinct())
        scratch.drop(now)
        now = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
