"""The 14 features, as real numbers and in fixed point, from flat transaction columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txscore import config as C
from txscore.functions.scalar import Q, clamp01, known_merchant, mcc_risk, quantize

#: The flat columns that features are made of.
FLAT = ["amount", "installments", "avg_amount", "tx_count_24h", "merchant_id", "known_merchants", "mcc", "merchant_avg", "is_online", "card_present", "km_from_home", "hour", "weekday", "epoch_minutes", "has_last", "last_minutes", "last_km"]


def real_features(unknown: Column | None = None) -> list[Column]:
    """f0..f13. The division for the ratio stands inside its condition, since ANSI mode refuses zero divisors."""
    c = F.col
    unknown = ~known_merchant(c("merchant_id"), c("known_merchants")) if unknown is None else unknown
    flag = lambda b: F.when(b, 1.0).otherwise(0.0)
    ratio = F.when(c("avg_amount") > 0, clamp01(F.try_divide("amount", "avg_amount") / C.AMOUNT_VS_AVG_RATIO)).otherwise(1.0)
    last = lambda x: F.when(c("has_last"), clamp01(x)).otherwise(-1.0)
    out = [
        clamp01(c("amount") / C.MAX_AMOUNT),
        clamp01(c("installments") / C.MAX_INSTALLMENTS),
        ratio,
        c("hour") / 23.0,
        c("weekday") / 6.0,
        last((c("epoch_minutes") - c("last_minutes")) / C.MAX_MINUTES),
        last(c("last_km") / C.MAX_KM),
        clamp01(c("km_from_home") / C.MAX_KM),
        clamp01(c("tx_count_24h") / C.MAX_TX_COUNT_24H),
        flag(c("is_online")),
        flag(c("card_present")),
        flag(unknown),
        mcc_risk(c("mcc")),
        clamp01(c("merchant_avg") / C.MAX_MERCHANT_AVG_AMOUNT),
    ]
    return [x.alias(f"f{d}") for d, x in enumerate(out)]


def quantized_features(unknown: Column | None = None) -> list[Column]:
    return [quantize(x).alias(name) for x, name in zip(real_features(unknown), Q, strict=True)]


def vectorize(tx: DataFrame, keep: list[str], unknown: Column | None = None) -> DataFrame:
    """tx with the columns of FLAT -> keep and q0..q13.

    The features are quantized in an array: as fourteen columns they and the join before them become one generated method,
    which is too long for the JVM to compile.
    """
    q = F.transform(F.array(*real_features(unknown)), quantize)
    return tx.select(*keep, q.alias("_q")).select(*keep, *[F.get("_q", F.lit(d)).alias(name) for d, name in enumerate(Q)])
