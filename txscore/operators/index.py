"""The partitioned reference index: partitions and leaves with bounds and label masks, writing, appending, checked opening."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from txscore import config as C
from txscore.functions.scalar import Q, partition_key

VERSION = 1
#: Vectors whose bounds to all boxes are one matrix.
_PAIRS = 500
#: Rows of a table of leaves up to which it is broadcast.
MOST_BROADCAST = 100_000
META = "scale int, dim int, version int, points bigint, fraud bigint, partitions bigint, leaf_size int"


def with_key(vectors: DataFrame) -> DataFrame:
    return vectors.withColumn("pk", partition_key())


def bounds(vectors: DataFrame, by: str = "pk", columns: list[str] | None = None) -> DataFrame:
    """Per group: n, the bit mask of its labels, and l0.., h0.. of its columns. One pre-aggregated shuffle of few rows."""
    columns = columns or Q
    low = [F.min(q).alias(f"l{d}") for d, q in enumerate(columns)]
    high = [F.max(q).alias(f"h{d}") for d, q in enumerate(columns)]
    return vectors.groupBy(by).agg(F.count("*").alias("n"), F.bit_or(F.expr("shiftleft(1, label)")).cast("int").alias("mask"), *low, *high)


def _arrays(boxes: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of boxes, and their bounds with a row a dimension."""
    found = boxes.collect()
    low, high = (np.array([[r[f"{s}{d}"] for r in found] for d in range(C.DIM)], np.float64) for s in "lh")
    return np.array([r.pk for r in found], np.int32), low, high


def _to_boxes(batch: pa.RecordBatch, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of a batch's vectors to boxes."""
    bound = np.zeros((batch.num_rows, low.shape[1]))
    for d, name in enumerate(Q):
        x = batch.column(name).to_numpy(zero_copy_only=False)[:, None]
        gap = np.maximum(low[d] - x, x - high[d])
        np.fmax(gap, 0, out=gap)
        gap *= gap
        bound += gap
    return bound


def boxes_within(vectors: DataFrame, boxes: DataFrame, radius: str, keep: list[str]) -> DataFrame:
    """keep (of vectors), and partitions_visited: how many boxes are of a vector's own pk or within its squared radius; null reaches none."""
    keys, low, high = _arrays(boxes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _PAIRS):
                batch = whole.slice(at, _PAIRS)
                limit = batch.column(radius).to_numpy(zero_copy_only=False).astype(np.float64)
                near = (_to_boxes(batch, low, high) <= limit[:, None]) | (batch.column("pk").to_numpy()[:, None] == keys)
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(near.sum(1).astype(np.int64))], names=[*keep, "partitions_visited"])

    types = dict(vectors.dtypes)
    return vectors.select(*keep, radius, "pk", *Q).mapInArrow(run, ", ".join([*[f"`{c}` {types[c]}" for c in keep], "partitions_visited long"]))


def box_bounds(vectors: DataFrame, boxes: DataFrame, key: str = "ref_id") -> DataFrame:
    """(key, pk, bound): the squared distances of every vector with pk to the boxes of all other keys, 256 at most.

    Whole matrices at once: a row a pair through a join's generated code takes three times as long.
    """
    keys, low, high = _arrays(boxes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _PAIRS):
                batch = whole.slice(at, _PAIRS)
                bound = _to_boxes(batch, low, high)
                other = batch.column("pk").to_numpy()[:, None] != keys
                i, j = np.nonzero(other)
                yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(i)), pa.array(keys[j]), pa.array(bound[other].astype(np.int64))], names=[key, "pk", "bound"])

    return vectors.select(key, "pk", *Q).mapInArrow(run, f"`{key}` long, pk int, bound long")


def widest() -> Column:
    """The dimension whose bounds are furthest apart, the first of equals."""
    spans = [F.struct((F.col(f"h{d}") - F.col(f"l{d}")).alias("w"), F.lit(-d).alias("d")) for d in range(C.DIM)]
    return (-F.greatest(*spans).getField("d")).alias("dim")


def median_split(vectors: DataFrame, by: str = "pk", key: str = "ref_id") -> DataFrame:
    """Every vector with the side of its group's median in the widest dimension: 0 for the first half, by value, then id."""
    boxes = bounds(vectors, by)
    dims = F.broadcast(boxes.select(by, "n", widest()))  # groups are partition keys: 256 at most
    x = vectors.join(dims, by).withColumn("v", F.get(F.array(*Q), F.col("dim")))
    place = F.row_number().over(Window.partitionBy(by).orderBy("v", key)) - 1
    return x.select(key, by, "dim", F.when(place < F.floor(F.col("n") / 2), 0).otherwise(1).alias("side"))


def _numbered(x: DataFrame, by: list[str], path: str) -> DataFrame:
    """x with `place`: the number, from 0, of a row in its leaf's order. No group is in one task.

    The rows are sorted over all tasks and written with their number within the partition; what is added to it is a
    sum over a table of one row for each partition and leaf.
    """
    spark = x.sparkSession
    x.orderBy("leaf", *by).withColumn("_id", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    part = F.shiftright("_id", 33)
    counts = rows.groupBy("leaf", part.alias("_part")).agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy("leaf").orderBy("_part")) - F.col("_n") - F.col("_first")
    offsets = counts.select("leaf", "_part", before.alias("_offset"))
    placed = rows.withColumn("_part", part).join(_small(offsets), ["leaf", "_part"])
    return placed.withColumn("place", F.col("_id") + F.col("_offset")).drop("_id", "_part", "_offset")


def _small(table: DataFrame) -> DataFrame:
    """For a broadcast, where its rows are few; else as it is, and then no leaf has a large share of the rows."""
    return F.broadcast(table) if table.count() <= MOST_BROADCAST else table


def leaves(vectors: DataFrame, path: str, leaf_size: int = C.LEAF_SIZE, levels: int = 32) -> DataFrame:
    """vectors (ref_id, q.., label) with pk and `leaf`: partition keys, halved down to leaf_size rows.

    Every turn halves all groups that are still too large at the exact median of their widest dimension, rows of one value by
    ref_id. A group's halves are 2 * leaf + 256 and one more. path: a folder of the cluster for the turns' tables.
    """
    x = with_key(vectors).withColumn("leaf", F.col("pk").cast("long"))
    done = None
    for turn in range(levels):
        boxes = bounds(x, "leaf").withColumn("halved", F.col("n") > leaf_size)
        dims = boxes.select("leaf", "n", "halved", widest())
        x = x.join(_small(dims), "leaf")
        whole = x.where("not halved").select(*vectors.columns, "pk", "leaf")
        done = whole if done is None else done.unionByName(whole)
        if not boxes.where("halved").limit(1).count():
            return done
        large = x.where("halved").withColumn("v", F.get(F.array(*Q), F.col("dim")))
        placed = _numbered(large, ["v", "ref_id"], f"{path}/turn-{turn}")
        side = F.when(F.col("place") < F.floor(F.col("n") / 2), 0).otherwise(1)
        x = placed.withColumn("leaf", F.col("leaf") * 2 + 256 + side).select(*vectors.columns, "pk", "leaf")
    return done.unionByName(x)


def build_index(vectors: DataFrame, path: str, leaf_size: int = C.LEAF_SIZE) -> None:
    """Writes references (ref_id, q0..q13, label) as an index: references by partition with their leaves, the bounds of both, and a header.

    An empty set of references is refused.
    """
    spark = vectors.sparkSession
    x = with_key(vectors.select("ref_id", *Q, "label"))
    counts = x.agg(F.count("*").alias("points"), F.sum("label").alias("fraud"), F.countDistinct("pk").alias("partitions")).first()
    if not counts.points:
        raise ValueError("no references to index")
    # several files a key, so that a key with a third of the rows isn't one task
    _write(leaves(x.drop("pk"), f"{path}/turns-{uuid.uuid4().hex}", C.leaf_size(leaf_size)), f"{path}/references", "overwrite")
    rows = spark.read.parquet(f"{path}/references")
    bounds(rows).coalesce(1).write.mode("overwrite").parquet(f"{path}/partitions")
    bounds(rows, "leaf").write.mode("overwrite").parquet(f"{path}/leaves")
    _write_header(spark, path, counts.points, counts.fraud, counts.partitions, C.leaf_size(leaf_size))


def _write(x: DataFrame, path: str, mode: str) -> None:
    # several files a key, so that a key with a third of the rows isn't one task
    salted = x.withColumn("_salt", F.pmod(F.xxhash64("ref_id"), F.lit(8)))
    parts = int(x.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted.repartition(parts, "pk", "_salt").drop("_salt").sortWithinPartitions("pk", "leaf", "ref_id").write.mode(mode).partitionBy("pk").parquet(path)


def _write_header(spark: SparkSession, path: str, points: int, fraud: int, partitions: int, leaf: int) -> None:
    header = spark.range(1).select(F.lit(C.SCALE).alias("scale"), F.lit(C.DIM).alias("dim"), F.lit(VERSION).alias("version"), F.lit(points).alias("points"), F.lit(fraud).alias("fraud"), F.lit(partitions).alias("partitions"), F.lit(leaf).alias("leaf_size"))
    header.coalesce(1).write.mode("overwrite").json(f"{path}/header")


def append_index(vectors: DataFrame, path: str) -> None:
    """Adds references to an index. Their own leaves are numbered like the index's; boxes, masks and counts are merged.

    An id that the index has is an error. An index that wasn't opened successfully isn't touched.
    """
    spark = vectors.sparkSession
    references, partitions, header = open_index(spark, path)
    x = vectors.select("ref_id", *Q, "label")
    if not x.join(references.select("ref_id"), "ref_id", "left_semi").isEmpty():
        raise ValueError("the index already has some of these references")
    _write(leaves(x, f"{path}/turns-{uuid.uuid4().hex}", header["leaf_size"]), f"{path}/references", "append")
    for by, old in (("pk", partitions), ("leaf", spark.read.parquet(f"{path}/leaves"))):
        new = bounds(with_key(x)) if by == "pk" else bounds(spark.read.parquet(f"{path}/references"), "leaf")
        merged = new
        if by == "pk":
            columns = [F.sum("n").alias("n"), F.bit_or("mask").alias("mask"), *[f(f"{c}{d}").alias(f"{c}{d}") for c, f in (("l", F.min), ("h", F.max)) for d in range(C.DIM)]]
            merged = old.unionByName(new).groupBy("pk").agg(*columns)
        folder = "partitions" if by == "pk" else "leaves"
        merged.write.parquet(f"{path}/{folder}-new")
        spark.read.parquet(f"{path}/{folder}-new").coalesce(1 if by == "pk" else 8).write.mode("overwrite").parquet(f"{path}/{folder}")
        _delete(spark, f"{path}/{folder}-new")
    counts = spark.read.parquet(f"{path}/partitions").agg(F.sum("n").alias("points"), F.count("*").alias("partitions")).first()
    fraud = x.agg(F.coalesce(F.sum("label"), F.lit(0))).first()[0]
    _write_header(spark, path, counts.points, header["fraud"] + fraud, counts.partitions, header["leaf_size"])


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def open_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    """(references, partitions, header) of an index, after its header and counts have been checked."""
    header = spark.read.schema(META).json(f"{path}/header").first()
    if header is None or (header.version, header.scale, header.dim) != (VERSION, C.SCALE, C.DIM):
        raise ValueError(f"not an index of this version: {json.dumps(header.asDict() if header else None)}")
    schema = ", ".join(["ref_id long", *[f"{q} int" for q in Q], "label int", "leaf long", "pk int"])
    references = spark.read.schema(schema).parquet(f"{path}/references")
    partitions = spark.read.parquet(f"{path}/partitions")
    found = partitions.agg(F.sum("n").alias("points"), F.count("*").alias("partitions")).first()
    if (found.points, found.partitions) != (header.points, header.partitions):
        raise ValueError("the index's partitions don't hold what its header says")
    return references, partitions, header.asDict()
