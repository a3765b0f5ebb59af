"""Reference vectors, transactions derived from the events table, and generated vectors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from txscore import config as C
from txscore.functions.features import vectorize
from txscore.functions.scalar import Q, epoch_minutes, quantize


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.gettempdir()
    return f"{root.rstrip('/')}/txscore/{name}-{uuid.uuid4().hex}"


def read_references(spark: SparkSession, path: str) -> DataFrame:
    """Records {"vector": [...], "label": ...} of a JSON array, also gzipped -> ref_id, q0..q13, label.

    The id is the record's place. Vectors of another length than 14 are an error; labels other than "fraud" are legit.
    A JSON array can't be split: convert large files once with build_index.
    """
    rows = spark.read.schema("vector array<double>, label string").option("multiLine", True).json(path)
    size = F.when(F.size("vector") == C.DIM, F.col("vector")).otherwise(F.raise_error(F.lit("a reference vector doesn't have 14 numbers")))
    rows = rows.select(size.alias("v"), F.when(F.col("label") == "fraud", C.FRAUD).otherwise(C.LEGIT).alias("label"))
    numbered = rows.withColumn("ref_id", F.monotonically_increasing_id())
    return numbered.select("ref_id", *[quantize(F.get("v", F.lit(d))).alias(Q[d]) for d in range(C.DIM)], "label")


def transactions(events: DataFrame) -> DataFrame:
    """The flat transaction columns of every event, with event_id, unknown_merchant and label.

    One shuffle by user_id serves all windows, as (user_id, merchant) is clustered by it too; the merchants' averages
    are an aggregate of a few rows, joined by broadcast, not a window on 20 keys.
    """
    cents = F.round(F.col("value") * 100).cast("long")
    base = events.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", cents.alias("cents"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    base = base.withColumn("m", F.col("k") % 20).withColumn("us", F.unix_micros("ts"))
    own = Window.partitionBy("user_id").orderBy("us", "event_id")
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    day = Window.partitionBy("user_id").orderBy("us").rangeBetween(-86_400_000_000, 0)
    same = Window.partitionBy("user_id", "m").orderBy("us", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    x = base.select(
        "*",
        F.sum("cents").over(before).alias("sum_before"),
        F.count("*").over(before).alias("n_before"),
        F.count("*").over(day).alias("tx_count_24h"),
        F.lag("us").over(own).alias("last_us"),
        F.lag("cents").over(own).alias("last_cents"),
    ).withColumn("n_same", F.count("*").over(same))
    merchants = base.groupBy("m").agg((F.sum("cents") * 25.0 / (F.count("*") * 100.0)).alias("merchant_avg"))
    x = x.join(F.broadcast(merchants), "m")  # k % 20: at most 20 rows
    codes = F.array(*[F.lit(c) for c in [*C.MCC_RISK, "9999"]])
    minutes = lambda us: F.floor(F.col(us) / F.lit(60_000_000.0)).cast("long")
    return x.select(
        "event_id",
        "user_id",
        "cents",
        (F.col("cents") * 25.0 / 100.0).alias("amount"),
        (1 + F.col("k") % 12).cast("long").alias("installments"),
        # the factor 25 / 100 of both cancels in the ratio
        F.when(F.col("n_before") > 0, F.col("sum_before") / F.col("n_before") * 25.0 / 100.0).otherwise(0.0).alias("avg_amount"),
        F.col("tx_count_24h"),
        F.concat(F.lit("MERC-"), F.lpad(F.col("m").cast("string"), 3, "0")).alias("merchant_id"),
        (F.col("n_same") == 0).alias("unknown_merchant"),
        F.get(codes, F.col("k") % 11).alias("mcc"),
        "merchant_avg",
        F.col("event_type").isin("click", "view").alias("is_online"),
        (F.col("event_type") == "purchase").alias("card_present"),
        ((F.col("event_id") * 37) % 1200).cast("double").alias("km_from_home"),
        F.hour("ts").alias("hour"),
        F.weekday("ts").alias("weekday"),
        epoch_minutes(F.col("ts")).alias("epoch_minutes"),
        F.col("last_us").isNotNull().alias("has_last"),
        minutes("last_us").alias("last_minutes"),
        (F.abs(F.col("cents") - F.col("last_cents")) * 3.0 / 100.0).alias("last_km"),
        F.when(F.col("event_type") == "error", C.FRAUD).otherwise(C.LEGIT).alias("label"),
    )


def event_vectors(events: DataFrame) -> DataFrame:
    """event_id, q0..q13, label of every event."""
    return vectorize(transactions(events), ["event_id", "label"], F.col("unknown_merchant")).select("event_id", *Q, "label")


def synthetic_vectors(spark: SparkSession, n: int) -> DataFrame:
    """i and q0..q13 of n generated query vectors, for warming up and load tests."""
    i = F.col("i")
    value = [((i * 313 + d * 1009) % (C.SCALE + 1)).cast("int") for d in range(C.DIM)]
    for d in (5, 6):
        value[d] = F.when(i.bitwiseAND(F.lit(3)) == 0, -C.SCALE).otherwise(value[d])
    for d, bit in ((9, 1), (10, 2), (11, 4)):
        value[d] = F.when(i.bitwiseAND(F.lit(bit)) != 0, C.SCALE).otherwise(value[d])
    return spark.range(n).select(F.col("id").alias("i")).select("i", *[v.cast("int").alias(Q[d]) for d, v in enumerate(value)])
