"""Helpers shared by the training-data operators: shared storage, text columns in Arrow, samples."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or, in a session of one machine only, one of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="txscore-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/txscore/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Writes df to the shared folder and reads it back, which cuts its lineage there."""
    path = new_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_few(df: DataFrame, name: str = "stage", at_most: int | None = None, rows_each: int = 100_000) -> DataFrame:
    """As materialize(), for tables that may be much shorter than their many partitions: read as one for each 100,000 rows.

    Else every exchange of a round over a short table leaves a file for each of its empty partitions. at_most: a bound of
    its rows, if one is known; then it is written in as few files.
    """
    out = materialize(df if at_most is None else df.coalesce(max(1, -(-at_most // rows_each))), name)
    rows = out.count()
    few = out.coalesce(max(1, -(-rows // rows_each)))
    few.txscore_source, few.txscore_rows = out, rows
    return few


def discard(*tables: DataFrame) -> None:
    """Deletes tables that materialize() wrote. Nothing that is computed later may need them."""
    for df in tables:
        jvm = df.sparkSession._jvm
        files = getattr(df, "txscore_source", df).inputFiles()
        if files:
            folder = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            folder.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


#: A key is hot if it has more than one in so many rows, and HOT_ROWS at least.
HOT_SHARE, HOT_ROWS = 20_000, 1000


def join_skewed(rows: DataFrame, groups: DataFrame, by: list[str], values: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """rows inner join groups (by, values, times), where a group has `times` rows and any group may have most of them.

    Rows of hot groups, of which there are HOT_SHARE at most, get theirs by broadcast; they go to the join as well, but
    under a salt of their own, so they spread.
    """
    total = groups.agg(F.sum("times")).first()[0] or 0
    limit = max(hot_rows, total // HOT_SHARE)
    hot = groups.where(F.col("times") > limit).select(*by, F.struct(*values).alias("_hot"))
    cold = groups.where(F.col("times") <= limit).select(*by, F.lit(0).alias("_salt"), F.struct(*values).alias("_cold"))
    salt = F.when(F.col("_hot").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(*rows.columns), F.lit(1024)).cast("int"))
    both = rows.join(F.broadcast(hot), by, "left").withColumn("_salt", salt).join(cold, [*by, "_salt"], "left")
    both = both.withColumn("_value", F.coalesce("_hot", "_cold")).where("_value is not null")
    return both.select(*rows.columns, *[F.col(f"_value.{v}").alias(v) for v in values])


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Bounds what one Arrow batch of long texts holds, by rows and (where Spark has it) by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def released(run):
    """run, a function over Arrow batches, that gives back the memory of its task at its end: workers live on for other tasks."""

    def out(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return out


def as_bytes(column: pa.Array) -> list:
    """A string column as a list of UTF-8 bytes or None; nothing is decoded."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def reader(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def hashed_sample(df: DataFrame, key: str, rows: int, seed: int) -> DataFrame:
    """At most `rows` rows of df, those with the smallest hashes of key; ties by all columns.

    A first filter on the hash leaves about twice as many, so that tasks don't each send `rows` rows to the sort.
    """
    total = df.count()
    h = F.xxhash64(F.col(key), F.lit(seed))
    if total > 2 * rows:
        df = df.where(F.pmod(h, F.lit(1 << 30)) < int((1 << 30) * 2 * rows / total))
    return df.orderBy(F.pmod(h, F.lit(1 << 30)), *df.columns).limit(rows)


def bounded_sample(labels: DataFrame, docs: DataFrame, rows: int, seed: int, text_bytes: int = 32 << 10) -> DataFrame:
    """At most `rows` labelled texts of `text_bytes` or less, chosen by the hash of their doc_id; documents aren't shuffled.

    The label rows that can be chosen are at most `rows`, which bounds what is broadcast; a doc_id with several labels gives
    several rows, a repeated document more, and of all these the first `rows` in the order of the hash stay. The
    bound on texts, a parameter of fitting as the number of rows is, bounds the one task that fits; scores use whole texts.
    """
    chosen = hashed_sample(labels.where(F.col("doc_id").isNotNull()), "doc_id", rows, seed)
    short = docs.select("doc_id", "text").where(F.col("text").isNull() | (F.octet_length("text") <= text_bytes))
    found = short.join(F.broadcast(chosen), "doc_id").dropDuplicates()
    return found.orderBy(F.xxhash64("doc_id", F.lit(seed)), *found.columns).limit(rows)
