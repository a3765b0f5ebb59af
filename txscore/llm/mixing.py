"""Mixing sources to target weights by entropy balancing.

A source's words should make up its target. Of all document rates between 0 and CAP whose words meet the targets, those
with the least relative entropy to "each document once" are exponential tilts: rate = min(CAP, exp(t[source] * size)).
The tilts solve a convex dual that falls apart into one equation a source; Newton steps, kept inside a bracket, solve
all of them at once, each step one aggregation over the counts of (source, size). Rates become whole copies by a hash
of doc_id as each document's own rounding threshold, moved by one shift a source, which a search by histograms sets
so that the copies' words come as near to the target as one document more or less allows.

Sums are of whole or decimal numbers, so reruns agree whatever the order of tasks.

Defined results: a null or empty text has size 0, is in its source and adds nothing. A null source is a source, the last.
A source without words has the target 0. Repeated rows count each and get equal copies. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from txscore.llm._common import materialize

WEIGHTS = (1, 2, 3)
#: No document is taken more often, and no target is more times its source's size.
CAP = 3
#: A table of one row a source is broadcast up to so many rows, and joined by a shuffle beyond.
BROADCAST_SOURCES = 20_000
_WORD = r"[^\x20\x09-\x0D]+"
_KEY = ["_none", "_source"]
_STEPS = 60
#: Rates, own thresholds and shifts are whole numbers of 2^-_TICK_BITS; a search of shifts from -1 to 1 takes three passes of _WAYS.
_TICK_BITS, _WAYS = 26, 512
#: Times that what a source misses its target by is closed with short documents.
REFINEMENTS = 1


def _with_key(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_none", F.col("source").isNull()).withColumn("_source", F.coalesce("source", F.lit("")))


def _by_source(rows: DataFrame, sources: DataFrame, count: int) -> DataFrame:
    return rows.join(F.broadcast(sources) if count <= BROADCAST_SOURCES else sources, _KEY)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """sizes (_none, _source, source_size) -> with weight and target: shares by weight of all sizes, at most cap times the source's size.

    What a capped source leaves is shared by the others by weight. That is: in the order of cap * size / weight the first
    source whose bound isn't below the level that is left for it and the later ones fixes the level. The windows hold one
    row a source.
    """
    in_order = Window.orderBy(*_KEY)
    place = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(in_order) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("weight", place.cast("long")).withColumn("bound", F.col("source_size") * cap)
    by_ratio = Window.orderBy(F.col("bound") / F.col("weight"), *_KEY)
    everything = Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("bound").over(before), F.lit(0)))
    rows = rows.withColumn("others", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    wide = lambda c: F.col(c).cast("decimal(19,0)")  # noqa: E731  products of two don't overflow
    level = F.when(wide("bound") * wide("others") >= wide("left") * wide("weight"), F.col("left") / F.col("others"))
    rows = rows.withColumn("level", F.min_by(level, F.when(level.isNotNull(), F.struct(F.col("bound") / F.col("weight"), *_KEY))).over(everything))
    target = F.least(F.col("bound").cast("double"), F.col("level") * F.col("weight"))
    return rows.select(*_KEY, "source_size", "weight", target.alias("target"))


def tilts(counts: DataFrame, sources: DataFrame, n_sources: int, cap: int = CAP) -> DataFrame:
    """counts (key, size, times), size > 0, and sources with targets -> (key, tilt, unit): rate = min(cap, exp(tilt * size / unit))."""
    top = F.log(F.lit(float(cap)))
    first = counts.groupBy(*_KEY).agg(F.sum(F.col("size") * F.col("times")).alias("all"), F.sum("times").alias("n"), F.min("size").alias("least"))
    first = first.join(sources.select(*_KEY, "target"), _KEY).withColumn("unit", F.col("all") / F.col("n"))
    shortest = F.col("least") / F.col("unit")
    state = first.select(
        *_KEY, "target", "unit", F.lit(0.0).alias("tilt"), (-(F.greatest(F.log(F.col("all") / F.greatest("target", F.lit(1e-9))), F.lit(0.0)) + 1) / shortest).alias("lo"), (top / shortest).alias("hi"), (F.col("target") >= F.col("all") * cap).alias("full")
    )
    # where a source is taken cap times as a whole, the upper end is the answer
    state = materialize(state.withColumn("tilt", F.when(F.col("full"), F.col("hi")).otherwise(0.0)).withColumn("open", ~F.col("full")).drop("full"), "tilts")
    x = F.col("size") / F.col("unit")
    rate = F.exp(F.least(F.col("tilt") * x, top))
    words = (F.col("size") * F.col("times") * rate).cast("decimal(38,9)")
    slope = F.when(F.col("tilt") * x < top, F.col("size") * F.col("times") * rate * x).otherwise(0.0).cast("decimal(38,9)")
    for _ in range(_STEPS):
        if not state.where("open").limit(1).count():
            break
        sums = _by_source(counts, state.where("open").select(*_KEY, "unit", "tilt"), n_sources).groupBy(*_KEY).agg((F.sum(words)).cast("double").alias("words"), F.sum(slope).cast("double").alias("slope"))
        both = state.join(F.broadcast(sums) if n_sources <= BROADCAST_SOURCES else sums, _KEY, "left")
        over = F.col("words") - F.col("target")
        both = both.withColumn("lo", F.when(over < 0, F.col("tilt")).otherwise(F.col("lo"))).withColumn("hi", F.when(over > 0, F.col("tilt")).otherwise(F.col("hi")))
        step = F.col("tilt") - F.try_divide(over, F.col("slope"))
        inside = F.when((step > F.col("lo")) & (step < F.col("hi")), step).otherwise((F.col("lo") + F.col("hi")) / 2)
        done = (F.abs(over) <= 1e-7 * F.col("target")) | (F.col("hi") - F.col("lo") <= 1e-13 * (F.abs("lo") + F.abs("hi")))
        new = both.select(*_KEY, "target", "unit", F.when(F.col("open") & ~done, inside).otherwise(F.col("tilt")).alias("tilt"), "lo", "hi", (F.col("open") & ~done).alias("open"))
        state = materialize(new, "tilts")
    return state.select(*_KEY, "tilt", "unit")


def _copies(shift, cap: int):
    """Copies of a document whose rate and own threshold make `ticks`, after a shift."""
    return F.least(F.greatest(F.shiftright(F.col("ticks") + shift, _TICK_BITS), F.lit(0).cast("long")), F.lit(cap).cast("long"))


def shifts(rated: DataFrame, sources: DataFrame, n_sources: int, cap: int = CAP) -> DataFrame:
    """rated (key, size, ticks) -> (key, shift, missing): copies whose words are nearest to the target, and what they miss it by.

    Each pass cuts a source's range of shifts into _WAYS and sums the words of the copies that begin in each, so a task
    sends _WAYS rows a source at most; the last one's ways are single ticks. All numbers are whole.
    """
    one = 1 << _TICK_BITS
    whole = lambda x: F.lit(x).cast("long")
    state = sources.where("target > 0").select(*_KEY, "target", whole(-one).alias("lo"), whole(one).alias("hi"), whole(None).alias("w_lo"), whole(None).alias("w_hi"))
    step = 2 * one
    while step > 1:
        began, step = step, step // _WAYS
        placed = _by_source(rated, state.select(*_KEY, "lo", "hi"), n_sources)
        least, most = _copies(F.col("lo"), cap), _copies(F.col("hi"), cap)
        way = lambda j: F.ceil((j * one - F.col("ticks") - F.col("lo")) / step)  # noqa: B023, E731  the first way whose end takes the copy
        more = F.when(most > least, F.transform(F.sequence(least + 1, most), lambda j: F.struct(way(j).alias("way"), F.col("size").alias("words"))))
        if began == 2 * one:  # later on w_lo has the words of what is taken at the lower end
            more = F.concat(F.array(F.struct(whole(0).alias("way"), (F.col("size") * least).alias("words"))), F.coalesce(more, F.array().cast("array<struct<way:bigint,words:bigint>>")))
        sums = placed.select(*_KEY, F.explode(more).alias("r")).groupBy(*_KEY, F.col("r.way").alias("way")).agg(F.sum("r.words").alias("words"))
        so_far = Window.partitionBy(*_KEY).orderBy("way").rowsBetween(Window.unboundedPreceding, 0)  # at most _WAYS + 1 rows a source
        sums = _by_source(sums, state.select(*_KEY, "target", "w_lo"), n_sources).withColumn("total", F.coalesce("w_lo", whole(0)) + F.sum("words").over(so_far))
        # the first way that takes more than the target; the totals rise
        sums = sums.groupBy(*_KEY).agg(F.min(F.when(F.col("total") > F.col("target"), F.struct("way", "total", "words"))).alias("over"), F.max("total").alias("top"))
        both = state.join(F.broadcast(sums) if n_sources <= BROADCAST_SOURCES else sums, _KEY, "left")
        found, low, end = F.col("over").isNotNull(), F.col("over.way") == 0, F.col("lo") + F.col("over.way") * step
        new = {
            "lo": F.when(found, F.greatest("lo", end - step)).when(F.col("top").isNotNull(), F.col("hi")).otherwise(F.col("lo")),
            "hi": F.when(found, end).otherwise(F.col("hi")),
            "w_lo": F.when(found & ~low, F.col("over.total") - F.col("over.words")).when(found, F.col("over.total")).otherwise(F.coalesce("top", "w_lo")),
            "w_hi": F.when(found, F.col("over.total")).otherwise(F.coalesce("top", "w_hi")),
        }
        state = materialize(both.select(*_KEY, "target", *[v.alias(k) for k, v in new.items()]), "shifts")
    upper = F.abs(F.col("w_hi") - F.col("target")) < F.abs(F.col("w_lo") - F.col("target"))
    return state.select(*_KEY, F.when(upper, F.col("hi")).otherwise(F.col("lo")).alias("shift"), (F.col("target") - F.when(upper, F.col("w_hi")).otherwise(F.col("w_lo"))).alias("missing"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target (of its source), copies, taken (words: copies * size)."""
    size = F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long")
    own = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(29)), 11) / F.lit(float(1 << 53))
    rows = materialize(_with_key(docs.select("doc_id", "source", size.alias("size"), own.alias("own"))), "sizes")
    counts = materialize(rows.groupBy(*_KEY, "size").agg(F.count("*").alias("times")), "counts")
    totals = counts.groupBy(*_KEY).agg(F.sum(F.col("size") * F.col("times")).alias("source_size"))
    sources = materialize(targets(totals, weights, cap), "targets")
    n_sources = sources.count()
    tilt = tilts(counts.where("size > 0"), sources, n_sources, cap)
    known = materialize(sources.join(tilt, _KEY, "left"), "sources")
    rated = _by_source(rows, known, n_sources).withColumn("rate", F.coalesce(F.exp(F.least(F.col("tilt") * F.col("size") / F.col("unit"), F.log(F.lit(float(cap))))), F.lit(0.0)))
    # at a rate of cap the own threshold can't add a copy more
    rated = materialize(rated.select("doc_id", "source", *_KEY, "size", "source_size", "target", F.round((F.col("rate") + F.col("own")) * (1 << _TICK_BITS)).cast("long").alias("ticks")), "rates")
    shift = shifts(rated.where("size > 0"), sources, n_sources, cap)
    for _ in range(REFINEMENTS):
        # a long document may leave a gap, which the documents that are no longer than the gap can close
        small = F.col("size") <= F.abs("missing")
        rated = materialize(rated.drop("missing").join(F.broadcast(shift) if n_sources <= BROADCAST_SOURCES else shift, _KEY, "left").withColumn("ticks", F.col("ticks") + F.coalesce("shift", F.lit(0).cast("long"))).drop("shift"), "rates")
        short = rated.where(small & (F.col("size") > 0))
        wanted = short.groupBy(*_KEY).agg((F.sum(F.col("size") * _copies(F.lit(0), cap)) + F.first("missing")).alias("target"))
        shift = shifts(short, wanted, n_sources, cap)
    missing = F.col("shift").isNotNull() & small
    out = rated.join((F.broadcast(shift) if n_sources <= BROADCAST_SOURCES else shift).drop("missing"), _KEY, "left")
    out = out.withColumn("shift", F.when(missing, F.col("shift")).otherwise(F.lit(0).cast("long")))
    copies = F.when(F.col("target") > 0, _copies(F.col("shift"), cap)).otherwise(0)
    out = out.withColumn("copies", copies.cast("long"))
    return out.select("doc_id", "source", "size", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), "copies", (F.col("copies") * F.col("size")).alias("taken"))
