"""Removal of repeated line runs with a suffix array over line numbers, in DataFrame operations only.

Every distinct repeated line gets a number; a document is the sequence of the numbers of its lines. Prefix doubling ranks
the suffixes by their first 1, 2, 4, ... lines: the rank of 2h lines at a place is the rank of the pair of the ranks of h
lines there and h lines on. Places that share a rank are the interval of the suffix array whose longest common prefix is at
least h lines; places whose prefix occurs once leave the computation. Intervals of other lengths are pairs of ranks: those
of the first and of the last h lines, where h is the largest power of two up to the length. So no task ever scans the
array's neighbours, and a line that a third of all rows share is no hot group.

A passage is a run of at least min_words words that is the shortest such run from its first line or up to its last. In the
interval of a passage the first place (by doc_id, then by line) is the first copy, the others are later ones. Later
copies that lie side by side, at one distance from first copies of one document, are joined: these are the maximal
repeated runs, since every repeated run of that many words is made of passages. Of a maximal run the lines go that aren't
lines of its own first copy, which a run that repeats within a document may overlap. So of 30 equal lines of 10 words the
first 5 stay. Doubling ends at the longest passage, which has at most min_words lines that count: a longer run is the
passages that make it up.

Lines and passages that many rows share are joined by a broadcast of a bounded table and dealt over all tasks; the others
are joined by a shuffle.

Defined results: lines are split at \\n and compared exactly; blank lines count for nothing, but those inside a run that
goes go with it. A null or empty text stays as it is. Rows without a doc_id take no part and stay. Rows that repeat doc_id
and text are one document. Within a document a later copy goes as well. Other columns pass through, whatever their names
are. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from txscore.llm._common import join_skewed, materialize

MIN_WORDS = 50
#: Rows of a key from which on it may be hot.
HOT_ROWS = 1000
#: Removed lines up to which they are broadcast to the documents, so that these aren't shuffled.
BROADCAST_LINES = 1_000_000
_WORD = r"[^\x20\x09-\x0D]+"
_KEY = ["_doc", "_hash"]


def _full_lines(text: Column) -> Column:
    """(place in the text, line) of the lines that have a word."""
    numbered = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    return F.filter(numbered, lambda s: s.x.rlike(_WORD))


def _lines(docs: DataFrame) -> DataFrame:
    """(_doc, _hash, pos, line, n, k1, k2): of the lines that have words their number among these and in the text, words, hashes."""
    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_hash"), F.posexplode(_full_lines(F.col("text"))).alias("pos", "l"))
    line = F.col("l.x")
    return rows.select(*_KEY, "pos", F.col("l.i").alias("line"), F.regexp_count(line, F.lit(_WORD)).alias("n"), F.xxhash64(line).alias("k1"), F.xxhash64(F.lit(7), line).alias("k2"))


def _ranked(pairs: DataFrame, by: list[str], name: str) -> DataFrame:
    """Adds rank: the number of a row's `by` in their order. Rows whose `by` occurs once are left out."""
    groups = pairs.groupBy(*by).agg(F.count("*").alias("times")).where("times > 1")
    # the partitions of a sort are ranges, so these numbers follow the order; written down, they stay
    groups = materialize(groups.orderBy(*by).withColumn("rank", F.monotonically_increasing_id()), f"{name}-ranks")
    return materialize(join_skewed(pairs, groups, by, ["rank"], HOT_ROWS).drop(*by), name)


def _passages(lines: DataFrame, min_words: int) -> DataFrame:
    """(_doc, _hash, pos, m, top, bottom): the shortest passages that begin or end at each line, from line top to bottom."""
    run = Window.partitionBy(*_KEY).orderBy("pos")
    rows = lines.select(*_KEY, "pos", "line", F.col("n").cast("long").alias("n")).distinct().withColumn("seg", F.col("pos") - F.row_number().over(run))
    own = Window.partitionBy(*_KEY, "seg")
    rows = rows.withColumn("end", F.sum("n").over(own.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))).withColumn("begin", F.col("end") - F.col("n"))
    on, back = own.orderBy("begin").rangeBetween(0, min_words - 1), own.orderBy("end").rangeBetween(1 - min_words, 0)
    rows = rows.select(*_KEY, "pos", "line", F.max("line").over(on).alias("bottom"), F.min("line").over(back).alias("top"), "begin", "end", F.count("*").over(on).alias("m"), F.max("end").over(on).alias("far"), F.count("*").over(back).alias("m_back"), F.min("begin").over(back).alias("near"))
    forward = F.when(F.col("far") - F.col("begin") >= min_words, F.struct("pos", "m", F.col("line").alias("top"), "bottom"))
    backward = F.when(F.col("end") - F.col("near") >= min_words, F.struct((F.col("pos") - F.col("m_back") + 1).cast("int").alias("pos"), F.col("m_back").alias("m"), "top", F.col("line").alias("bottom")))
    return rows.select(*_KEY, F.explode(F.array_compact(F.array(forward, backward))).alias("s")).select(*_KEY, "s.*").distinct()


def suffix_ranks(lines: DataFrame, levels: int) -> list[DataFrame]:
    """For h = 1, 2, 4, ...: (_doc, _hash, pos, rank) of the suffixes whose first h lines occur more than once, in their order."""
    out = [lines.select(*_KEY, "pos", "rank")]
    for k in range(levels):
        a = out[-1].withColumnRenamed("rank", "a")
        b = out[-1].select(*_KEY, (F.col("pos") - (1 << k)).alias("pos"), F.col("rank").alias("b"))
        out.append(_ranked(a.join(b, [*_KEY, "pos"]), ["a", "b"], f"doubled-{k}"))
    return out


def maximal_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The later copies of the maximal repeated runs, as lines top to bottom of (_doc, _hash).

    first_doc and first_top tell where the first copy is; first_bottom is the last line of a first copy in the
    same document, else null.
    """
    if min_words < 1:
        raise ValueError("min_words must be at least 1")
    lines = _ranked(materialize(_lines(docs), "all-lines"), ["k1", "k2"], "lines")
    passages = materialize(_passages(lines, min_words), "passages")
    most = passages.agg(F.max("m")).first()[0] or 1
    ranks = suffix_ranks(lines, most.bit_length() - 1)
    level = F.floor(F.log2(F.col("m") + 0.5)).cast("int")
    sized = passages.withColumn("level", level)
    table = None
    for k, r in enumerate(ranks):
        r = r.withColumn("level", F.lit(k))
        table = r if table is None else table.unionByName(r)
    first = table.withColumnRenamed("rank", "a")
    last = table.select(*_KEY, "level", F.col("pos").alias("_at"), F.col("rank").alias("b"))
    known = sized.join(first, [*_KEY, "level", "pos"]).withColumn("_at", F.expr("pos + m - shiftleft(1L, level)")).join(last, [*_KEY, "level", "_at"])
    known = materialize(known.select(*_KEY, "pos", "m", "top", "bottom", "a", "b"), "known")
    place = F.struct(*_KEY, "pos")
    starts = known.groupBy("m", "a", "b").agg(F.min(F.struct(*_KEY, "pos", "top", "bottom")).alias("first"), F.count("*").alias("times")).where("times > 1")
    copies = join_skewed(known, materialize(starts, "intervals"), ["m", "a", "b"], ["first"], HOT_ROWS)
    later = copies.where(place > F.struct("first._doc", "first._hash", "first.pos"))
    later = later.select(*_KEY, "pos", (F.col("pos") + F.col("m")).alias("end"), "top", "bottom", F.col("first._doc").alias("first_doc"), F.col("first._hash").alias("first_hash"), F.col("first.top").alias("first_top"), F.col("first.bottom").alias("first_bottom"), (F.col("pos") - F.col("first.pos")).alias("away"))
    side = Window.partitionBy(*_KEY, "first_doc", "first_hash", "away").orderBy("pos", "end")
    new = F.coalesce(F.col("pos") > F.max("end").over(side.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    runs = later.withColumn("_new", new.cast("int")).withColumn("_run", F.sum("_new").over(side.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy(*_KEY, "first_doc", "first_hash", "away", "_run").agg(F.min("top").alias("top"), F.max("bottom").alias("bottom"), F.min("first_top").alias("first_top"), F.max("first_bottom").alias("first_bottom"))
    same = (F.col("first_doc") == F.col("_doc")) & (F.col("first_hash") == F.col("_hash"))
    return runs.select(*_KEY, "top", "bottom", "first_doc", "first_top", F.when(same, F.col("first_bottom")).alias("first_bottom"))


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(_doc, _hash, gone): of each document that loses lines, their numbers."""
    begin = F.greatest(F.col("top"), F.coalesce(F.col("first_bottom") + 1, F.lit(0)))  # a run begins after its first copy does
    runs = maximal_runs(docs, min_words).withColumn("begin", begin).where("begin <= bottom")
    gone = runs.select(*_KEY, F.explode(F.sequence("begin", "bottom")).alias("line"))
    return gone.groupBy(*_KEY).agg(F.collect_set("line").alias("gone"))  # bounded by the lines of one text


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the text that stays, and n_lines and n_removed (columns of these names are replaced)."""
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    gone = materialize(repeated_lines(docs, min_words), "gone")
    if (gone.agg(F.sum(F.size("gone"))).first()[0] or 0) <= BROADCAST_LINES:
        gone = F.broadcast(gone)
    row = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row")
    joined = docs.select(row, F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_hash")).join(gone, _KEY, "left").select("_row", "gone", F.col("_row.text").alias("_text"))
    # a generator's output is computed once; a projected split would be repeated for each line it is indexed by
    split = F.when(F.col("gone").isNotNull(), F.split("_text", "\n"))
    joined = joined.select("*", F.explode(F.array(split)).alias("_lines"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "gone")
    text = F.when(F.col("gone").isNull(), F.col("_text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("_lines", i)), "\n"))
    n_lines = F.when(F.col("_text").isNull(), 0).otherwise(F.char_length("_text") - F.char_length(F.replace("_text", F.lit("\n"))) + 1).cast("long")
    n_removed = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long")
    out = {"text": text, "n_lines": n_lines, "n_removed": n_removed}
    return joined.select(*[out[c].alias(c) if c in out else F.col(f"_row.`{c}`").alias(c) for c in [*columns, "n_lines", "n_removed"]])
