"""Transactions as JSON, one a line: schema, parsing into flat columns, and whether each is valid."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txscore.functions.scalar import timestamp_parts


def _struct(**fields: str) -> T.StructType:
    return T.StructType([T.StructField(k, T._parse_datatype_string(v)) for k, v in fields.items()])


PAYLOAD_DDL = """id string,
transaction struct<amount: double, installments: bigint, requested_at: string>,
customer struct<avg_amount: double, tx_count_24h: bigint, known_merchants: array<string>>,
merchant struct<id: string, mcc: string, avg_amount: double>,
terminal struct<is_online: boolean, card_present: boolean, km_from_home: double>,
last_transaction struct<timestamp: string, km_from_current: double>,
_corrupt string"""

#: Places where a null is refused although a missing key is not.
_NOT_NULL = ["transaction", "transaction.amount", "transaction.installments", "transaction.requested_at", "customer", "customer.avg_amount", "customer.tx_count_24h", "customer.known_merchants", "merchant", "merchant.id", "merchant.mcc", "merchant.avg_amount", "terminal", "terminal.is_online", "terminal.card_present", "terminal.km_from_home", "last_transaction.timestamp", "last_transaction.km_from_current"]
_MOST = 4_294_967_295


def _nulls(parsed: Column) -> Column:
    """Whether one of the places of a parsed text is a null; a missing one isn't, nor is one of text that is no JSON."""
    tests = [F.coalesce(F.is_variant_null(F.try_variant_get(parsed, f"$.{p}", "variant")), F.lit(False)) for p in _NOT_NULL]
    return reduce(lambda a, b: a | b, tests)


def parse_payloads(rows: DataFrame, text: str = "value") -> DataFrame:
    """rows with `text` -> their other columns, the flat columns of features, and valid.

    Missing keys have zero values; a missing or null last_transaction is none. Not valid: what isn't JSON of this schema,
    a null elsewhere, counts below 0 or above 32 bits, and times that can't be read. Two divergences from lenient
    scanners: a comma after the last member is refused, and of a repeated object the last one counts.
    """
    p = F.from_json(F.col(text), PAYLOAD_DDL, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    keep = [c for c in rows.columns if c != text]
    x = rows.select(*keep, F.col(text).alias("_text"), p.alias("p"), F.try_parse_json(F.col(text)).alias("_parsed"))
    # a generator's output is computed once; a projected one would be parsed again for each test
    x = x.withColumn("_parsed", F.explode(F.array("_parsed"))).withColumn("_nulls", _nulls(F.col("_parsed")))
    c = F.col
    at, last = timestamp_parts(c("p.transaction.requested_at")), timestamp_parts(c("p.last_transaction.timestamp"))
    x = x.withColumn("_at", at).withColumn("_last", last)
    zero = lambda name, v: F.coalesce(c(name), F.lit(v))
    installments, count = zero("p.transaction.installments", 0), zero("p.customer.tx_count_24h", 0)
    readable = lambda given, got: c(given).isNull() | c(got).isNotNull()
    valid = c("_text").isNotNull() & c("p").isNotNull() & c("p._corrupt").isNull() & ~c("_nulls") & installments.between(0, _MOST) & count.between(0, _MOST) & readable("p.transaction.requested_at", "_at") & readable("p.last_transaction.timestamp", "_last")
    return x.select(
        *keep,
        F.coalesce(valid, F.lit(False)).alias("valid"),
        zero("p.transaction.amount", 0.0).alias("amount"),
        installments.alias("installments"),
        zero("p.customer.avg_amount", 0.0).alias("avg_amount"),
        count.alias("tx_count_24h"),
        zero("p.merchant.id", "").alias("merchant_id"),
        F.coalesce("p.customer.known_merchants", F.array().cast("array<string>")).alias("known_merchants"),
        zero("p.merchant.mcc", "").alias("mcc"),
        zero("p.merchant.avg_amount", 0.0).alias("merchant_avg"),
        zero("p.terminal.is_online", False).alias("is_online"),
        zero("p.terminal.card_present", False).alias("card_present"),
        zero("p.terminal.km_from_home", 0.0).alias("km_from_home"),
        zero("_at.hour", 0).alias("hour"),
        zero("_at.weekday", 0).alias("weekday"),
        F.coalesce("_at.epoch_minutes", F.lit(0).cast("long")).alias("epoch_minutes"),
        c("p.last_transaction").isNotNull().alias("has_last"),
        F.coalesce("_last.epoch_minutes", F.lit(0).cast("long")).alias("last_minutes"),
        zero("p.last_transaction.km_from_current", 0.0).alias("last_km"),
    )
