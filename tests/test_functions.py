import datetime as dt
import math

from pyspark.sql import functions as F

from txscore import config as C
from txscore.functions import scalar
from txscore.sources.tables import synthetic_vectors


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_quantize(spark):
    cases = {-2.0: -10000, -1.0: -10000, -0.5: 0, 0.0: 0, 0.00005: 1, 0.00004999: 0, 0.25: 2500, 1.0: 10000, 3.0: 10000, float("inf"): 10000, float("nan"): 0}
    rows = spark.createDataFrame([(k,) for k in cases], "v double").select("v", scalar.quantize(F.col("v")).alias("q")).collect()
    for r in rows:
        want = 0 if math.isnan(r.v) else cases[r.v]
        assert r.q == want, r


def test_clamp_keeps_nan_apart(spark):
    assert one(spark, scalar.quantize_clamped(F.lit(float("nan")))) == 0
    assert one(spark, scalar.clamp01(F.lit(-3.0))) == 0.0
    assert one(spark, scalar.clamp01(F.lit(3.0))) == 1.0


def test_mcc(spark):
    for code, want in [("5411", 0.15), ("7995", 0.85), ("9999", 0.5), ("", 0.5), ("541", 0.5), ("54110", 0.5)]:
        assert one(spark, scalar.mcc_risk(F.lit(code))) == want
    assert one(spark, scalar.mcc_risk(F.lit(None).cast("string"))) == 0.5
    assert one(spark, scalar.mcc_slot_risk(F.lit(5411))) == 1500
    assert one(spark, scalar.mcc_slot_risk(F.lit(5411 + C.MCC_SLOTS))) == 1500
    assert one(spark, scalar.mcc_slot_risk(F.lit(1))) == 5000


def test_known_merchant(spark):
    known = F.array(F.lit("MERC-001"), F.lit("MERC-010"))
    for name, want in [("MERC-001", True), ("MERC-010", True), ("MERC-01", False), ("MERC-0", False), ("MERC-0100", False), ("", False)]:
        assert one(spark, scalar.known_merchant(F.lit(name), known)) is want
    assert one(spark, scalar.known_merchant(F.lit("a"), F.lit(None).cast("array<string>"))) is False


def parts(spark, text):
    r = one(spark, scalar.timestamp_parts(F.lit(text).cast("string")))
    return None if r is None else (r.epoch_minutes, r.hour, r.weekday)


def test_timestamps(spark):
    minutes = lambda *a: int(dt.datetime(*a, tzinfo=dt.timezone.utc).timestamp()) // 60
    assert parts(spark, "2026-03-11T20:23:35Z") == (minutes(2026, 3, 11, 20, 23), 20, 2)
    assert parts(spark, "1970-01-05T00:00:00Z")[2] == 0
    assert parts(spark, "1970-01-04T00:00:00Z")[2] == 6
    assert parts(spark, "2026-03-15T00:00:00Z")[2] == 6
    assert parts(spark, "2026-03-11T20:23:35Z")[0] - parts(spark, "2026-03-11T14:58:35Z")[0] == 325
    assert parts(spark, "2026-02-31T00:00:00Z")[0] == minutes(2026, 3, 3)
    assert parts(spark, "2026-03-11T00:00:60Z")[0] == minutes(2026, 3, 11, 0, 1)
    assert parts(spark, "2026-03-11T20:23:35+03:00") == parts(spark, "2026-03-11T20:23:35Z")
    assert parts(spark, "2026/03/11 20.23.35Z") == parts(spark, "2026-03-11T20:23:35Z")
    for bad in ["2026-03-11T20:23:35", "2026-13-11T20:23:35Z", "2026-00-11T20:23:35Z", "2026-03-32T20:23:35Z", "2026-03-11T24:23:35Z", "2026-03-11T20:60:35Z", "2026-03-11T20:23:61Z", "20x6-03-11T20:23:35Z", "", None]:
        assert parts(spark, bad) is None, bad


def test_partition_key(spark):
    def key(**q):
        columns = [F.lit(q.get(f"q{d}", 0)) for d in range(C.DIM)]
        return one(spark, scalar.partition_key(columns))

    assert key() == 1
    assert key(q5=-10000) == 0
    assert key(q5=-10000, q9=10000, q10=10000, q11=10000, q12=8000, q2=5000, q8=3000) == 0b11111110
    assert [key(q12=v) for v in (2047, 2048, 4095, 4096, 6143, 6144)] == [1, 17, 17, 33, 33, 49]


def test_bounds_and_distances(spark):
    q = [F.lit(5)] * C.DIM
    assert one(spark, scalar.box_bound(q, [F.lit(0)] * C.DIM, [F.lit(9)] * C.DIM)) == 0
    assert one(spark, scalar.box_bound(q, [F.lit(7)] * C.DIM, [F.lit(9)] * C.DIM)) == 4 * C.DIM
    far = [F.lit(10000)] * C.DIM
    assert one(spark, scalar.squared_distance(far, [F.lit(-10000)] * C.DIM)) == C.DIM * 400_000_000


def test_responses(spark):
    got = spark.range(7).select(scalar.response(*scalar.decision(F.col("id"))).alias("r")).collect()
    assert [r.r for r in got] == ['{"approved":%s,"fraud_score":%s}' % ("true" if n < 3 else "false", n / 5) for n in (0, 1, 2, 3, 4, 5, 5)]


def test_synthetic(spark):
    rows = [tuple(r)[1:] for r in synthetic_vectors(spark, 64).orderBy("i").collect()]
    for i, row in enumerate(rows):
        want = [(i * 313 + d * 1009) % 10001 for d in range(C.DIM)]
        if i & 3 == 0:
            want[5] = want[6] = -10000
        for d, bit in ((9, 1), (10, 2), (11, 4)):
            if i & bit:
                want[d] = 10000
        assert list(row) == want


def test_leaf_size():
    assert [C.leaf_size(x) for x in (None, "x", 7, 8, 1024, 1025, "64")] == [256, 256, 256, 8, 1024, 256, 64]
