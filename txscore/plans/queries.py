"""A query for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from txscore import config as C
from txscore.functions import features, scalar
from txscore.functions.scalar import Q
from txscore.operators import index, knn
from txscore.plans.oracles import ORACLES  # noqa: F401
from txscore.sources.payload import parse_payloads
from txscore.sources.tables import event_vectors, read, read_references, shared_path, synthetic_vectors, transactions
from txscore.streaming.scorer import Scorer


def _unknown():
    return F.col("unknown_merchant")


def _tx(spark, sf_dir) -> DataFrame:
    return transactions(read(spark, sf_dir, "events"))


def _vectors(spark, sf_dir) -> DataFrame:
    return event_vectors(read(spark, sf_dir, "events"))


def _references(spark, sf_dir) -> DataFrame:
    return _vectors(spark, sf_dir).withColumnRenamed("event_id", "ref_id")


def _stored_vectors(spark, sf_dir) -> str:
    path = shared_path(spark, "vectors")
    _vectors(spark, sf_dir).write.parquet(path)
    return path


def _search_tables(spark, sf_dir, path: str = "") -> tuple[DataFrame, DataFrame]:
    """Queries and references, of vectors that are made once. path: where they have been stored before."""
    x = spark.read.parquet(path or _stored_vectors(spark, sf_dir))
    return x.select(F.col("event_id").alias("query_id"), *Q), x.withColumnRenamed("event_id", "ref_id")


def _some(*dims: int) -> list:
    every = features.quantized_features(_unknown())
    return [every[d] for d in dims]


def quantize_amount(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", scalar.quantize_clamped(F.col("o_totalprice") / C.MAX_AMOUNT).alias("q0"))


def feature_ratio(spark, sf_dir):
    x = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), F.col("o_custkey") == F.col("c_custkey"), "left")
    ratio = F.when(F.col("c_acctbal") > 0, scalar.clamp01(F.try_divide("o_totalprice", "c_acctbal") / C.AMOUNT_VS_AVG_RATIO)).otherwise(1.0)
    return x.select("o_orderkey", scalar.quantize(ratio).alias("q2"))


def feature_time(spark, sf_dir):
    return _tx(spark, sf_dir).select("event_id", "epoch_minutes", "hour", "weekday", *_some(3, 4))


def feature_last_tx(spark, sf_dir):
    return _tx(spark, sf_dir).select("event_id", *_some(5, 6))


def feature_velocity(spark, sf_dir):
    return _tx(spark, sf_dir).select("event_id", "tx_count_24h", *_some(8))


def feature_known_merchant(spark, sf_dir):
    return _tx(spark, sf_dir).select("event_id", *_some(11))


def feature_mcc_risk(spark, sf_dir):
    return _tx(spark, sf_dir).select("event_id", "mcc", *_some(12))


def features_real(spark, sf_dir):
    return _tx(spark, sf_dir).select("event_id", *[F.round(f, 9).alias(f"f{d}") for d, f in enumerate(features.real_features(_unknown()))])


def mcc_table_1024(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", scalar.mcc_slot_risk(F.col("p_partkey") * 7).alias("risk"))


def partition_key(spark, sf_dir):
    return _vectors(spark, sf_dir).select("event_id", scalar.partition_key().alias("pk"))


def _boxes(spark, sf_dir) -> DataFrame:
    return index.bounds(index.with_key(_vectors(spark, sf_dir)))


def widest_dim(spark, sf_dir):
    return _boxes(spark, sf_dir).select("pk", index.widest())


def median_split(spark, sf_dir):
    return index.median_split(index.with_key(_references(spark, sf_dir)))


def box_lower_bound(spark, sf_dir):
    """Of each event the bounds of all partitions but its own; partitions are 256 at most, so they go to all tasks."""
    x = index.with_key(_search_tables(spark, sf_dir)[1])
    return index.box_bounds(x, index.bounds(x)).withColumnRenamed("ref_id", "event_id")


def l2_distance(spark, sf_dir):
    """Squared distances of events and the events before them, by id."""
    x = _vectors(spark, sf_dir).select("event_id", *Q)
    ids = x.select("event_id")
    # the id before: ids are cut into ranges, and each range's first row looks at the largest id before it
    ranges = ids.withColumn("r", F.floor(F.col("event_id") / 4096))
    own = Window.partitionBy("r").orderBy("event_id")
    last = ranges.groupBy("r").agg(F.max("event_id").alias("last"))
    before = last.withColumn("prev_last", F.lag("last").over(Window.orderBy("r"))).select("r", "prev_last")  # a row a range
    pairs = ranges.join(before, "r").select("event_id", F.coalesce(F.lag("event_id").over(own), "prev_last").alias("prev"))
    a, b = x.select("event_id", *[F.col(q).alias(f"a_{q}") for q in Q]), x.select(F.col("event_id").alias("prev"), *[F.col(q).alias(f"b_{q}") for q in Q])
    joined = pairs.join(a, "event_id").join(b, "prev")
    return joined.select("event_id", scalar.squared_distance([F.col(f"a_{q}") for q in Q], [F.col(f"b_{q}") for q in Q]).alias("d2"))


def knn_top5(spark, sf_dir):
    return knn.knn(None, _search_tables(spark, sf_dir)[1], leave_out=True, stored=True)


def knn_vote(spark, sf_dir):
    return knn.vote(None, _search_tables(spark, sf_dir)[1], leave_out=True, stored=True).drop("partitions")


def knn_vote_blocks(spark, sf_dir):
    queries, references = _search_tables(spark, sf_dir)
    return knn.votes(queries, knn.knn(queries, references, leave_out=True, strategy="blocks"))


def knn_approximate(spark, sf_dir):
    """Neighbours that may not be the nearest where five of the own partition are within the early-stop distance."""
    return knn.knn(None, _search_tables(spark, sf_dir)[1], leave_out=True, approximate=True, stored=True)


def index_leaves(spark, sf_dir):
    """Bounds and label masks of the leaves below the partitions."""
    return index.bounds(index.leaves(_search_tables(spark, sf_dir)[1], shared_path(spark, "leaves")), "leaf")


def probe_stats(spark, sf_dir):
    """How many partitions an exact search must visit: the own one, and those whose boxes the fifth neighbour's distance reaches."""
    queries, references = _search_tables(spark, sf_dir)
    found = knn.knn(queries, references, leave_out=True).groupBy("query_id").agg(F.max(F.when(F.col("rank") == C.K, F.col("d2"))).alias("d5"), F.sum("label").alias("votes"))
    asked = index.with_key(queries).join(found, "query_id")
    each = index.boxes_within(asked, index.bounds(index.with_key(references)), "d5", ["votes"]).where("partitions_visited > 0")
    return each.groupBy("partitions_visited").agg(F.count("*").alias("queries"), F.sum("votes").cast("long").alias("votes"))


def embedding_knn(spark, sf_dir):
    """The same search over another number of dimensions, with signed fixed-point numbers."""
    rows = read(spark, sf_dir, "embeddings")
    dims = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    names = [f"q{d}" for d in range(dims)]
    x = rows.select("vec_id", *[scalar.quantize_signed(F.get("embedding", F.lit(d))).alias(names[d]) for d in range(dims)])
    found = knn.knn(x.withColumnRenamed("vec_id", "query_id"), x.withColumnRenamed("vec_id", "ref_id").withColumn("label", F.lit(0)), leave_out=True, columns=names)
    return found.drop("label")


def synthetic(spark, sf_dir):
    return synthetic_vectors(spark, 4_096)


def payload_json(tx: DataFrame) -> DataFrame:
    """query_id and the nested JSON of each transaction."""
    c = F.col
    at = lambda minutes: F.concat(F.date_format(F.timestamp_seconds(c(minutes) * 60), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    known = F.when(c("unknown_merchant"), F.array().cast("array<string>")).otherwise(F.array(c("merchant_id")))
    last = F.when(c("has_last"), F.struct(at("last_minutes").alias("timestamp"), c("last_km").alias("km_from_current")))
    nested = F.struct(
        F.concat(F.lit("tx-"), c("event_id")).alias("id"),
        F.struct("amount", "installments", at("epoch_minutes").alias("requested_at")).alias("transaction"),
        F.struct("avg_amount", "tx_count_24h", known.alias("known_merchants")).alias("customer"),
        F.struct(c("merchant_id").alias("id"), "mcc", c("merchant_avg").alias("avg_amount")).alias("merchant"),
        F.struct("is_online", "card_present", "km_from_home").alias("terminal"),
        last.alias("last_transaction"),
    )
    return tx.select(c("event_id").alias("query_id"), F.to_json(nested, {"ignoreNullFields": "false"}).alias("value"))


def json_payload_parse(spark, sf_dir):
    flat = parse_payloads(payload_json(_tx(spark, sf_dir)))
    return flat.select(F.col("query_id").alias("event_id"), "valid", F.round("amount", 9).alias("amount"), "installments", "tx_count_24h", "mcc", "is_online", "card_present", F.round("km_from_home", 9).alias("km_from_home"), "epoch_minutes", "hour", "weekday", "has_last", "last_minutes")


def payload_edges(spark, sf_dir):
    """Payloads with every tenth in its own way odd: which are valid, and what of them is read."""
    rows = payload_json(_tx(spark, sf_dir))
    value, odd = F.col("value"), F.pmod("query_id", F.lit(10))
    edits = {
        1: F.lit(None).cast("string"),
        2: F.substring(value, 1, 40),
        3: F.replace(value, F.lit('"tx_count_24h":'), F.lit('"tx_count_24h":-')),
        4: F.regexp_replace(value, '"mcc":"[0-9]+"', '"mcc":null'),
        5: F.regexp_replace(value, '"installments":[0-9]+,', ""),
        6: F.replace(value, F.lit('{"id"'), F.lit('{ "extra" : [1, {"a": null}],\n "id"')),
        7: F.regexp_replace(value, '"requested_at":"([0-9]{4})-[0-9]{2}', '"requested_at":"$1-13'),
        8: F.regexp_replace(value, r'"last_transaction":\{[^}]*\}', '"last_transaction":null'),
        9: F.regexp_replace(value, r'"known_merchants":\[[^\]]*\]', '"known_merchants":null'),
    }
    for k, edit in edits.items():
        value = F.when(odd == k, edit).otherwise(value)
    flat = parse_payloads(rows.withColumn("value", value))
    known = scalar.known_merchant(F.col("merchant_id"), F.col("known_merchants"))
    only = lambda c: F.when(F.col("valid"), c)
    return flat.select(F.col("query_id").alias("event_id"), "valid", only(F.col("installments")).alias("installments"), only(F.col("has_last")).alias("has_last"), only(known).alias("known"))


def known_merchant(spark, sf_dir):
    """Whether a merchant's id is in a list, among ids that begin alike, an empty one and a null."""
    m = _tx(spark, sf_dir).select("event_id", "merchant_id", F.pmod("event_id", F.lit(20)).alias("j"))
    other = F.concat(F.lit("MERC-"), F.lpad(F.col("j").cast("string"), 3, "0"))
    asked = F.when(F.col("j") == 7, "").when(F.col("j") == 8, F.substring("merchant_id", 1, 7)).otherwise(F.col("merchant_id"))
    listed = F.array(F.lit(""), F.lit("MERC-0"), other, F.when(F.col("j") % 3 == 0, F.col("merchant_id")))
    return m.select("event_id", scalar.known_merchant(asked, listed).alias("known"))


def score_json(spark, sf_dir):
    """Requests end to end, from JSON to the answer: of each eight one is missing, one cut off, one too long, one with a count below 0."""
    rows = payload_json(_tx(spark, sf_dir))
    value, odd = F.col("value"), F.pmod("query_id", F.lit(8))
    cut, long = F.substring(value, 1, 40), F.concat(value, F.lit(" " * 5_000))
    negative = F.replace(value, F.lit('"installments":'), F.lit('"installments":-'))
    edited = F.when(odd == 0, F.lit(None)).when(odd == 1, cut).when(odd == 2, long).when(odd == 3, negative).otherwise(value)
    return Scorer(_references(spark, sf_dir)).score(rows.select("query_id", edited.alias("value")))


def reference_json(spark, sf_dir):
    """References written as JSON arrays of records, read back, and summed up by label."""
    path = shared_path(spark, "reference-json")
    real = F.array(*[F.col(q) / F.lit(float(C.SCALE)) for q in Q])
    label = F.when(F.col("label") == C.FRAUD, "fraud").otherwise("legit")
    records = _references(spark, sf_dir).select(F.floor(F.col("ref_id") / 1_000).alias("file"), F.to_json(F.struct(real.alias("vector"), label.alias("label"))).alias("r"))
    # an array is a file, as it can't be split: of a thousand records each
    arrays = records.groupBy("file").agg(F.concat(F.lit("["), F.array_join(F.collect_list("r"), ","), F.lit("]")).alias("value"))
    arrays.write.partitionBy("file").text(path)
    back = read_references(spark, path)
    return back.groupBy("label").agg(F.count("*").alias("n"), *[F.sum(q).alias(q) for q in Q])


def fraud_response_json(spark, sf_dir):
    n = spark.range(C.K + 1).select(F.col("id").alias("n"))
    return n.select("n", scalar.response(*scalar.decision(F.col("n"))).alias("response"))


def stream_score(spark, sf_dir):
    """All events as one available-now stream: vectors in files, searched batch by batch against the references."""
    sink, state = (shared_path(spark, n) for n in ("stream-out", "stream-state"))
    source = _stored_vectors(spark, sf_dir)
    references = _search_tables(spark, sf_dir, source)[1]
    files = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", 64).parquet(source)
    stream = files.select(F.col("event_id").alias("query_id"), *Q)
    if knn.few(references, Q):
        sent = spark.sparkContext.broadcast(knn.collect_references(index.with_key(references), Q))
        answers = knn.vote(stream, references, leave_out=True, sent=sent).drop("partitions").writeStream.format("parquet").option("path", sink)
    else:
        cells = knn.Cells(index.with_key(references), Q, C.K, knn.BLOCK_ROWS, stored=True)

        def answer(batch: DataFrame, number: int) -> None:
            # a batch that is done again writes its own folder again
            knn.vote(batch, references, leave_out=True, cells=cells).drop("partitions").write.mode("overwrite").parquet(f"{sink}/batch={number}")

        answers = stream.writeStream.foreachBatch(answer)
    answers.option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("query_id long, fraud_count int, fraud_score double, approved boolean").parquet(sink).select("query_id", "fraud_count", "fraud_score", "approved")


def _header(spark, path) -> DataFrame:
    _, _, header = index.open_index(spark, path)
    return spark.createDataFrame([(header["points"], header["fraud"], header["partitions"])], "points long, fraud long, partitions long")


def index_counts(spark, sf_dir):
    """Builds an index, opens it with its checks, and reports its header."""
    path = shared_path(spark, "index")
    index.build_index(_references(spark, sf_dir), path)
    return _header(spark, path)


def index_append(spark, sf_dir):
    """Builds an index of two thirds of the references, appends the rest, and returns the partitions' bounds that it has then."""
    path, references = shared_path(spark, "index"), _references(spark, sf_dir)
    index.build_index(references.where("ref_id % 3 != 0"), path)
    index.append_index(references.where("ref_id % 3 = 0"), path)
    _, partitions, _ = index.open_index(spark, path)
    return partitions.select("pk", "n", "mask", *[f"{s}{d}" for d in range(C.DIM) for s in "lh"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "quantize_amount": quantize_amount,
    "feature_ratio": feature_ratio,
    "feature_time": feature_time,
    "feature_last_tx": feature_last_tx,
    "feature_velocity": feature_velocity,
    "feature_known_merchant": feature_known_merchant,
    "feature_mcc_risk": feature_mcc_risk,
    "features_real": features_real,
    "mcc_table_1024": mcc_table_1024,
    "tx_vector": _vectors,
    "partition_key": partition_key,
    "partition_bounds": lambda spark, sf_dir: _boxes(spark, sf_dir).drop("mask"),
    "label_mask": lambda spark, sf_dir: _boxes(spark, sf_dir).select("pk", "mask"),
    "widest_dim": widest_dim,
    "median_split": median_split,
    "box_lower_bound": box_lower_bound,
    "l2_distance": l2_distance,
    "knn_top5": knn_top5,
    "knn_vote": knn_vote,
    "knn_vote_blocks": knn_vote_blocks,
    "embedding_knn": embedding_knn,
    "synthetic_vectors": synthetic,
    "json_payload_parse": json_payload_parse,
    "fraud_response_json": fraud_response_json,
    "knn_approximate": knn_approximate,
    "index_leaves": index_leaves,
    "probe_stats": probe_stats,
    "stream_score": stream_score,
    "index_counts": index_counts,
    "index_append": index_append,
    "payload_edges": payload_edges,
    "known_merchant": known_merchant,
    "score_json": score_json,
    "reference_json": reference_json,
}
