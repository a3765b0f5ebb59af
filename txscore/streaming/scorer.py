"""Scoring of JSON transactions, in batch and as a stateless stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txscore import config as C
from txscore.functions.features import vectorize
from txscore.functions.scalar import Q, decision, response
from txscore.operators.index import open_index, with_key
from txscore.operators.knn import BLOCK_ROWS, Cells, collect_references, few, vote
from txscore.sources.payload import parse_payloads
from txscore.sources.tables import shared_path

#: Longer requests are answered like ones that can't be read.
MOST_BYTES = 4_096


class Scorer:
    """Holds the references of an index, broadcast once or, where they are too many, cut into cells once; every batch reuses them."""

    def __init__(self, references: DataFrame):
        self.references = references
        self.sent = self.cells = None
        if few(references, Q):
            self.sent = references.sparkSession.sparkContext.broadcast(collect_references(with_key(references.drop("pk")), Q))
        else:
            self.cells = Cells(with_key(references.drop("pk")), Q, C.K, BLOCK_ROWS)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Scorer:
        return cls(open_index(spark, path)[0])

    def ready(self) -> str:
        return "ok"

    def score(self, requests: DataFrame, key: str = "query_id", text: str = "value") -> DataFrame:
        """requests (query_id, value) -> query_id, valid, fraud_count, fraud_score, approved, response.

        What isn't valid passes with score 0 (it fails open) and stays visible as valid = false. Narrow: also for streams,
        unless the references are in cells; then a stream's batches can be scored one by one.
        """
        sized = requests.select(F.col(key).cast("long").alias("query_id"), F.when(F.octet_length(text) <= MOST_BYTES, F.col(text)).alias("value"))
        flat = parse_payloads(sized)
        vectors = vectorize(flat, ["query_id", "valid"])
        # the id carries valid through the search, which keeps only ids
        coded = vectors.withColumn("query_id", F.col("query_id") * 2 + F.col("valid").cast("long"))
        found = self._in_cells(coded) if self.cells else vote(coded, self.references, sent=self.sent)
        valid = F.col("query_id").bitwiseAND(F.lit(1)) == 1
        return found.select(
            F.floor(F.col("query_id") / 2).cast("long").alias("query_id"),
            valid.alias("valid"),
            F.when(valid, F.col("fraud_count")).otherwise(0).alias("fraud_count"),
            F.when(valid, F.col("fraud_score")).otherwise(0.0).alias("fraud_score"),
            F.when(valid, F.col("approved")).otherwise(True).alias("approved"),
            response(F.col("fraud_score"), F.col("approved"), valid).alias("response"),
        )

    def _in_cells(self, coded: DataFrame) -> DataFrame:
        """The votes of coded requests; those that aren't valid are answered without a search."""
        if coded.isStreaming:
            raise ValueError("the references are in cells; score a stream's batches one by one, as score_stream does")
        path = shared_path(coded.sparkSession, "requests")
        coded.write.parquet(path)
        rows = coded.sparkSession.read.parquet(path)
        found = vote(rows.where("valid").drop("valid"), self.references, cells=self.cells).drop("partitions")
        none = rows.where("not valid").select("query_id", F.lit(0).alias("fraud_count"), *decision(F.lit(0)))
        return found.unionByName(none)


def score_stream(scorer: Scorer, source: str, sink: str, checkpoint: str, files_per_batch: int = 100, every: str | None = None):
    """Reads JSON lines ({"query_id": .., "value": ".."}) from a folder as they come and appends answers to a parquet folder.

    every: the time between batches of a stream that goes on ("1 second"); without it, it ends when all that is there is answered.
    """
    spark = scorer.references.sparkSession
    lines = spark.readStream.schema("query_id long, value string").option("maxFilesPerTrigger", files_per_batch).json(source)
    if scorer.cells:

        def answer(batch: DataFrame, number: int) -> None:
            # a batch that is done again writes its own folder again
            scorer.score(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

        answers = lines.writeStream.foreachBatch(answer)
        return answers.option("checkpointLocation", checkpoint).trigger(**({"processingTime": every} if every else {"availableNow": True})).start()
    return scorer.score(lines).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(**({"processingTime": every} if every else {"availableNow": True})).start()
