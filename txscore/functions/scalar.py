"""Column functions: fixed-point features, partition keys, bounds and distances. All are built-in expressions."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from txscore import config as C

Q = [f"q{d}" for d in range(C.DIM)]


#: The number before one half: a positive x plus it, rounded down, is x to the nearest, halves up, without round()'s decimals.
_HALF = 0.49999999999999994


def clamp01(x: Column) -> Column:
    """x held to 0..1. NaN, which Spark sorts above all numbers, stays."""
    return F.when(F.isnan(x), x).when(x < 0, 0.0).when(x > 1, 1.0).otherwise(x)


def quantize(x: Column) -> Column:
    """-1..1 to whole ten-thousandths, half away from zero; -1 and less to -10000, the rest up to 0 to 0, NaN to 0."""
    return F.when(F.isnan(x), 0).when(x <= -1, -C.SCALE).when(x <= 0, 0).when(x >= 1, C.SCALE).otherwise(F.floor(x * C.SCALE + _HALF)).cast("int")


def quantize_clamped(x: Column) -> Column:
    return quantize(clamp01(x))


def quantize_signed(x: Column) -> Column:
    """Ten-thousandths with their sign, for vectors that aren't features."""
    return F.round(x.cast("double") * C.SCALE).cast("long")


def mcc_risk(mcc: Column) -> Column:
    table = F.create_map(*[F.lit(v) for pair in C.MCC_RISK.items() for v in pair])
    return F.coalesce(F.try_element_at(table, mcc), F.lit(C.DEFAULT_MCC_RISK))


def mcc_slots() -> list[int]:
    """The table of MCC_SLOTS risks: a code's slot is its number modulo the size, so codes can share one."""
    slots = [round(C.DEFAULT_MCC_RISK * C.SCALE)] * C.MCC_SLOTS
    for code, risk in C.MCC_RISK.items():
        slots[int(code) % C.MCC_SLOTS] = round(risk * C.SCALE)
    return slots


def mcc_slot_risk(mcc: Column) -> Column:
    """The risk in a code's slot, in ten-thousandths. Written as the few slots that differ from the default."""
    default = round(C.DEFAULT_MCC_RISK * C.SCALE)
    slot = F.pmod(mcc, F.lit(C.MCC_SLOTS))
    out = F.lit(default)
    for k, v in enumerate(mcc_slots()):
        if v != default:
            out = F.when(slot == k, v).otherwise(out)
    return out.cast("int")


def known_merchant(merchant: Column, known: Column) -> Column:
    """Whether a merchant's whole id is in the list; an empty id isn't."""
    return F.coalesce((merchant != "") & F.array_contains(known, merchant), F.lit(False))


def epoch_days(year: Column, month: Column, day: Column) -> Column:
    """Days since 1970-01-01; days past a month's end run into the next month."""
    return F.datediff(F.date_add(F.make_date(year, month, F.lit(1)), day - 1), F.lit("1970-01-01").cast("date"))


def timestamp_parts(text: Column) -> Column:
    """Fixed-place ISO time to (epoch_minutes, hour, weekday with Monday 0), null if it isn't one.

    At least 20 characters; what stands between the numbers and the zone is not looked at, 31 days are fine for any
    month, and so is second 60.
    """
    part = [F.substr(text, F.lit(at), F.lit(n)) for at, n in ((1, 4), (6, 2), (9, 2), (12, 2), (15, 2), (18, 2))]
    digits = reduce(lambda a, b: a & b, [p.rlike(f"^[0-9]{{{n}}}$") for p, n in zip(part, (4, 2, 2, 2, 2, 2), strict=True)])
    y, mo, d, h, mi, s = (F.try_to_number(p, F.lit("9" * n)).cast("int") for p, n in zip(part, (4, 2, 2, 2, 2, 2), strict=True))
    fine = (F.char_length(text) >= 20) & digits & mo.between(1, 12) & d.between(1, 31) & (h <= 23) & (mi <= 59) & (s <= 60) & (y >= 1)
    days = epoch_days(y, mo, d)
    minutes = (days.cast("long") * C.MINUTES_PER_DAY + h * 60 + mi + F.floor(s / 60)).cast("long")
    return F.when(fine, F.struct(minutes.alias("epoch_minutes"), h.alias("hour"), F.pmod(days + 3, F.lit(7)).alias("weekday")))


def epoch_minutes(ts: Column) -> Column:
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(60_000_000.0)).cast("long")


def partition_key(q: list[Column] | None = None) -> Column:
    """The key 0..255: bits for a last transaction, online, card, unknown merchant, two for the risk, ratio and velocity."""
    q = q or [F.col(c) for c in Q]
    bit = lambda test, at: F.when(test, 1 << at).otherwise(0)
    risk = F.when(q[12] <= 2047, 0).when(q[12] <= 4095, 1).when(q[12] <= 6143, 2).otherwise(3) * 16
    return (bit(q[5] >= 0, 0) + bit(q[9] > 0, 1) + bit(q[10] > 0, 2) + bit(q[11] > 0, 3) + risk + bit(q[2] > 4096, 6) + bit(q[8] > 2048, 7)).cast("int")


def _square(x: Column) -> Column:
    return x * x


def box_bound(q: list[Column], low: list[Column], high: list[Column]) -> Column:
    """The squared distance from a vector to a box; 0 inside."""
    gaps = [F.greatest(lo - x, x - hi, F.lit(0)).cast("long") for x, lo, hi in zip(q, low, high, strict=True)]
    return reduce(add, map(_square, gaps))


def squared_distance(a: list[Column], b: list[Column]) -> Column:
    return reduce(add, (_square((x - y).cast("long")) for x, y in zip(a, b, strict=True)))


def decision(votes: Column) -> tuple[Column, Column]:
    """(fraud_score, approved) of a count of fraud neighbours."""
    n = F.least(votes, F.lit(C.K))
    return (n / F.lit(float(C.K))).alias("fraud_score"), (n < C.DENY_AT).alias("approved")


def response(score: Column, approved: Column, valid: Column | None = None) -> Column:
    """The JSON answer. What can't be read is approved with score 0."""
    if valid is not None:
        score, approved = F.when(valid, score).otherwise(0.0), F.when(valid, approved).otherwise(True)
    return F.to_json(F.struct(approved.alias("approved"), score.alias("fraud_score")))
