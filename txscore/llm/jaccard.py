"""Self-join of documents on n-gram Jaccard similarity by rare-first prefix filtering, and its components.

A document's set holds the hashes of its distinct word shingles. All sets are ordered by one global order, rare shingles
first: by a fixed-size count sketch over all documents, then by hash. Two sets that reach the threshold share a shingle
among the first few of both, so each set sends only this prefix to the shuffle on shingles, and sets that meet there are
tested by length, by the place of the shared shingle and by the spread of the remaining hashes. A pair that passes is
verified once, on whole sets.

Equal sets are one class and are joined as one. In a large bucket of a shingle a set isn't paired with all others, but
with the first that passes of the bucket's hub, its smallest set so far, and of the few sets before. Links
between those are verified and their components built. Rounds of likely pairs between components follow, and after them
all pairs of different components that share a bucket, each set against the bucket's largest component. So a group of n
near copies costs far fewer than n * n pairs, and still no link between components is lost.

That is enough for components. For links, a component's sets are then dealt into salted blocks, and each pair of blocks
verifies every pair of its sets once, on whole sets: a link never leaves its component, so these are all links.

Defined results: a text with fewer words than a shingle has is one shingle of them all; an empty or null text has the
empty set, is linked with nothing and is its own component. Rows with the same text are one class. A row without a
doc_id takes no part, has a null component and no links. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import deque
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txscore.llm._common import as_bytes, discard, materialize, materialize_few, released, small_batches
from txscore.llm.components import connected_components

#: log2 of the counters of the sketch of shingle frequencies, and of those in a block of it; fixed, so what is broadcast is too.
SKETCH_BITS, BLOCK_BITS = 21, 16
#: log2 of the bits of the filter of wanted documents.
FILTER_BITS = 23
#: The first so many sets of a bucket are all paired; later ones with the hub only, at first.
SMALL = 6
#: Before all pairs between components are tested, so many rounds test a few likely ones of each set, which join most components.
ROUNDS, TRIES, RECENT = 2, 3, 12
#: So many ids of sets to verify are broadcast at most, 16 MB or so.
BROADCAST_NODES = 500_000
#: Of a component, a block holds about so many sets and so many shingles at most; a pair of blocks is verified at once.
BLOCK_SETS, BLOCK_SHINGLES = 512, 500_000
#: Columns of the dense matrix whose product counts common shingles.
_WIDTH = 4096
_CELLS = 16
_U = np.uint64
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


class _Words(dict):
    """Hashes of words; emptied when it grows too large."""

    def __missing__(self, word):
        if len(self) >= 1 << 18:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_hashes(text: bytes | None, n: int, words: dict) -> np.ndarray:
    """The distinct hashes, sorted, of the n-word shingles; words are [^\\x20\\x09-\\x0D]+ after lower-casing A-Z."""
    found = text.translate(_LOWER).split() if text else []
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    with np.errstate(over="ignore"):
        width = min(n, len(h))
        out = np.full(len(h) - width + 1, 0x9E3779B97F4A7C15 + width, np.uint64)
        for j in range(width):
            out = _mix(out * _U(0x100000001B3) + h[j : len(h) - width + 1 + j])
    return np.unique(out)


def _signature(h: np.ndarray) -> tuple[int, int]:
    return struct.unpack("<qq", hashlib.blake2b(h.tobytes(), digest_size=16).digest())


#: Ids of dropped documents up to which keep_one() broadcasts them.
BROADCAST_DROPPED = 1_000_000


class Threshold:
    """Jaccard of at least percent / 100, in whole numbers."""

    def __init__(self, percent: int):
        if not 0 < percent <= 100:
            raise ValueError("percent must be in 1..100")
        self.percent = percent

    def prefix(self, n: int) -> int:
        return n - -(-self.percent * n // 100) + 1

    def overlap(self, both: int) -> int:
        """The least common size of two sets with this many elements together."""
        return -(-self.percent * both // (100 + self.percent))


def _sets(n: int):
    """Pass over the texts: a row (0, doc_id, size, signature) for each document, and (1, block, .., counters) of the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sketch = _Words(), np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                h = shingle_hashes(text, n, words)
                hi, lo = _signature(h) if len(h) else (None, None)
                if doc is not None and len(h):
                    np.add.at(sketch, (h >> _U(64 - SKETCH_BITS)).astype(np.int64), 1)
                rows.append((0, doc, len(h), hi, lo, None))
            if rows:
                yield _batch(rows)
        for k, part in enumerate(sketch.reshape(-1, 1 << BLOCK_BITS)):
            if part.any():
                yield _batch([(1, k, None, None, None, zlib.compress(part.tobytes(), 1))])

    return run


_ROW = ["kind", "doc_id", "n", "hi", "lo", "counters"]
_ROW_SQL = "kind int, doc_id long, n long, hi long, lo long, counters binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.int64()] * 4, pa.binary()), strict=True)], names=_ROW)


def _summed(table: pa.Table) -> pa.Table:
    """Adds the counters of blocks of one number."""
    total = np.zeros(1 << BLOCK_BITS, np.uint64)
    for blob in table["counters"]:
        total += np.frombuffer(zlib.decompress(blob.as_buffer()), np.uint32)
    total = np.minimum(total, (1 << 32) - 1).astype(np.uint32)
    return pa.table({"doc_id": table["doc_id"].slice(0, 1), "counters": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})


def _sketch(first: DataFrame) -> np.ndarray:
    """The counters of all tasks, added up in two steps, so that no group holds a block of each task."""
    blocks = first.where("kind = 1").select("doc_id", "counters")
    shares = blocks.groupBy("doc_id", F.pmod(F.xxhash64("counters"), F.lit(16)).alias("share"))
    added = shares.applyInArrow(_summed, "doc_id long, counters binary").groupBy("doc_id").applyInArrow(_summed, "doc_id long, counters binary").toArrow()
    counts = np.zeros((1 << SKETCH_BITS - BLOCK_BITS, 1 << BLOCK_BITS), np.uint32)
    for k, blob in zip(added["doc_id"].to_pylist(), added["counters"].to_pylist(), strict=True):
        counts[k] = np.frombuffer(zlib.decompress(blob), np.uint32)
    return counts.ravel()


def _prefixes(n: int, limit: Threshold, counts):
    """Pass over the texts: the prefix of each set, once in a task for equal sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, rare, seen = _Words(), counts.value, set()
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in range(7)]
            for doc, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                h = shingle_hashes(text, n, words)
                if doc is None or not len(h):
                    continue
                sig = _signature(h)
                if sig in seen:
                    continue
                if len(seen) >= 1 << 20:
                    seen.clear()
                seen.add(sig)
                keep = limit.prefix(len(h))
                chosen = np.lexsort((h, rare[(h >> _U(64 - SKETCH_BITS)).astype(np.int64)]))[:keep]
                own = (h & _U(_CELLS - 1)).astype(np.int64)
                after = np.bincount(own, minlength=_CELLS) - np.cumsum(np.eye(_CELLS, dtype=np.int64)[own[chosen]], 0)
                cells = np.ascontiguousarray(after.astype(np.uint8)).view(np.int64)  # modulo 256
                for x, v in zip(out, (h[chosen].view(np.int64), np.full(keep, sig[0]), np.full(keep, sig[1]), np.full(keep, len(h)), np.arange(keep), cells[:, 0], cells[:, 1]), strict=True):
                    x.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(t), pa.from_numpy_dtype(t)) for x, t in zip(out, (np.int64, np.int64, np.int64, np.int32, np.int32, np.int64, np.int64), strict=True)], names=["token", "hi", "lo", "n", "pos", "c1", "c2"])

    return run


_PREFIX_SQL = "token long, hi long, lo long, n int, pos int, c1 long, c2 long"


def _may_link(a: tuple, b: tuple, limit: Threshold) -> bool:
    """Of two prefix entries (n, pos, cells) of one shingle: the length, positional and suffix filters.

    cells counts the set's later shingles by their last bits, modulo 256. If the shingle is the first that both share,
    the ones before it differ, and the later ones differ at least by what the counts do; where it isn't the first, the
    pair may be refused here, since the first one's bucket has it too.
    """
    if 100 * min(a[0], b[0]) < limit.percent * max(a[0], b[0]):
        return False
    need = limit.overlap(a[0] + b[0])
    spare = a[0] + b[0] - 2 * need - a[1] - b[1]
    if spare < 0 or min(a[0] - a[1], b[0] - b[1]) < need:
        return False
    return sum(min(d, 256 - d) for d in map(abs, map(int.__sub__, a[2], b[2]))) <= spare


def _cells(c1: np.ndarray, c2: np.ndarray) -> list[list[int]]:
    return np.ascontiguousarray(np.stack([c1, c2], 1)).view(np.uint8).reshape(-1, _CELLS).tolist()


def _buckets(limit: Threshold):
    """Streams over entries sorted by shingle and size: pairs of small buckets, pairs with hubs, and the entries of large buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, before, hub, size, last, held = None, [], None, 0, None, []
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            t = columns[0]
            # places that share their shingle with a neighbour; the others can't make a pair
            same = np.zeros(len(t), bool)
            same[1:] = t[1:] == t[:-1]
            touched = same.copy()
            touched[:-1] |= same[1:]
            if len(t):
                touched[0] |= t[0] == token
                touched[-1] = True
            pairs: list[tuple] = []
            kept: list[tuple] = []
            part = [c[touched] for c in columns]
            for k, hi, lo, n, pos, c1, c2, cell in zip(*(c.tolist() for c in part), _cells(*part[5:]), strict=True):
                if k != token:
                    token, before, hub, size, last, held = k, [], None, 0, None, []
                if (hi, lo) == last:
                    continue
                last = (hi, lo)
                row, own = (n, pos, cell), (hi, lo)
                if hub is None or 100 * hub[0][0] < limit.percent * n:
                    hub = (row, own)
                elif size >= SMALL:
                    pairs += [(0, *x[1], *own, 0, 0, 0, 0) for x in islice((x for x in (hub, *before) if _may_link(x[0], row, limit)), 1)]
                if size < SMALL:
                    pairs += [(0, *x[1], *own, 0, 0, 0, 0) for x in before if _may_link(x[0], row, limit)]
                before = [*before[1 - SMALL :], (row, own)]
                size += 1
                entry = (1, hi, lo, k, 0, n, pos, c1, c2)
                if size <= SMALL:
                    held.append(entry)
                else:
                    kept += [*held, entry]
                    held = []
            if rows := pairs + kept:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.int64()] * 4, pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=_FOUND)

    return run


#: kind 0: a pair of classes (a, b, c, d); kind 1: an entry of class (a, b) in the bucket of shingle c.
_FOUND = ["kind", "a", "b", "c", "d", "n", "pos", "c1", "c2"]
_FOUND_SQL = "kind int, a long, b long, c long, d long, n int, pos int, c1 long, c2 long"


def _wanted_sets(n: int, bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, want, seen = _Words(), np.frombuffer(bits.value, np.uint8), set()
        for batch in batches:
            ids, sets = [], []
            for doc, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                if doc is not None and want[(s := _slot(doc)) >> 3] >> (s & 7) & 1:
                    h = shingle_hashes(text, n, words).view(np.int64)
                    # a repeated row once in a task, so that rows of one doc_id don't all meet later
                    own = (doc, *_signature(h))
                    if own in seen:
                        continue
                    if len(seen) >= 1 << 18:
                        seen.clear()
                    seen.add(own)
                    ids.append(doc)
                    sets.append(h)
            if ids:
                flat, ends = np.concatenate(sets), np.cumsum([0, *map(len, sets)])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))], names=["node", "s"])

    return run


def _slot(doc: int) -> int:
    return (doc * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 64 - FILTER_BITS


def _sets_of(nodes: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """(node, s): the sets of these documents, and of few others, from one pass over the texts with a fixed-size filter."""

    def slots(batches):
        table = np.zeros(1 << FILTER_BITS - 3, np.uint8)
        for batch in batches:
            with np.errstate(over="ignore"):
                s = (batch.column(0).to_numpy().view(np.uint64) * _U(0x9E3779B97F4A7C15) >> _U(64 - FILTER_BITS)).astype(np.int64)
            np.bitwise_or.at(table, s >> 3, (1 << (s & 7)).astype(np.uint8))
        blocks = table.view(np.int64)
        at = np.flatnonzero(blocks)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(blocks[at], pa.int64())], names=["at", "bits"])

    table = np.zeros(1 << FILTER_BITS - 6, np.int64)
    found = nodes.mapInArrow(slots, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    table[found["at"].to_numpy()] = found["bits"].to_numpy()
    bits = docs.sparkSession.sparkContext.broadcast(table.tobytes())
    return materialize(docs.mapInArrow(released(_wanted_sets(n, bits)), "node long, s array<long>"), "wanted")


def _verified(pairs: DataFrame, sets: DataFrame, limit: Threshold) -> DataFrame:
    """pairs (a, b) of class representatives -> those that reach the threshold, on whole sets."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    # ids of a checked number; beyond it the join shuffles all sets
    sets = sets.join(F.broadcast(nodes) if nodes.count() <= BROADCAST_NODES else nodes, "node", "left_semi")
    a = sets.select(F.col("node").alias("a"), F.col("s").alias("sa"))
    b = sets.select(F.col("node").alias("b"), F.col("s").alias("sb"))
    both = pairs.join(b, "b").join(a, "a")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(100 * common >= limit.percent * (F.size("sa") + F.size("sb") - common)).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links).

    Links within a component that is known already aren't looked for; jaccard_join() counts them, near_pairs() returns them.
    """
    return _joined(docs, n, percent, "components")


def jaccard_join(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """near_duplicates() with n_links: how many other doc_ids the document is linked with, those with its own set included."""
    return _joined(docs, n, percent, "links")


def near_pairs(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """(a, b), a < b: every link between different sets, each set as the smallest doc_id that has it."""
    return _joined(docs, n, percent, "pairs")


def _joined(docs: DataFrame, n: int, percent: int, want: str) -> DataFrame:
    spark, limit = docs.sparkSession, Threshold(percent)
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    first = materialize(docs.mapInArrow(released(_sets(n)), _ROW_SQL), "sets")
    counts = _sketch(first)
    rows = first.where("kind = 0")
    docs_of = [F.count_distinct("doc_id").alias("docs")] if want == "links" else []
    classes = rows.where("doc_id is not null and hi is not null").groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), *docs_of)
    classes = materialize(classes, "classes")
    entries = docs.mapInArrow(released(_prefixes(n, limit, spark.sparkContext.broadcast(counts))), _PREFIX_SQL)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_entries = entries.repartition(parts, "token").sortWithinPartitions("token", "n", "hi", "lo")
    found = materialize(sorted_entries.mapInArrow(released(_buckets(limit)), _FOUND_SQL), "found")

    def rep(df, hi, lo, name):
        return df.join(classes.select(F.col("hi").alias(hi), F.col("lo").alias(lo), F.col("rep").alias(name)), [hi, lo]).drop(hi, lo)

    pairs = found.where("kind = 0").select("a", "b", "c", "d").distinct()
    pairs = rep(rep(pairs, "a", "b", "x"), "c", "d", "y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    pairs = materialize_few(pairs, "pairs")
    large = rep(found.where("kind = 1").select("a", "b", F.col("c").alias("token"), "n", "pos", "c1", "c2"), "a", "b", "node")
    large = materialize_few(large, "large")
    sets = _sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(large.select("node")), docs, n)
    links = materialize_few(_verified(pairs, sets, limit), "links")
    component = connected_components(links)
    for turn in range(ROUNDS):
        tried = _likely(large, component, pairs, limit, turn)
        if tried is None:
            break
        pairs = pairs.unionByName(tried)
        links, old = materialize_few(links.unionByName(_verified(tried, sets, limit)), "links"), links
        component, before = connected_components(links), component
        discard(old, before)
    rest = _between(large, component, pairs, limit)
    if not rest.isEmpty():
        links = materialize_few(links.unionByName(_verified(rest, sets, limit)), "links")
        component = connected_components(links)
    if want != "components":
        linked = materialize(_within(component, classes, sets, limit, want), "within")
    discard(found, large, sets, links)
    if want == "pairs":
        return linked
    known = classes.join(component.withColumnRenamed("node", "rep"), "rep", "left")
    found_links = []
    if want == "links":
        known = known.join(linked.withColumnRenamed("node", "rep"), "rep", "left").withColumn("n_links", F.coalesce("linked", F.lit(0)) + F.col("docs") - 1)
        found_links = ["n_links"]
    known = known.select("hi", "lo", F.coalesce("component", "rep").alias("component_id"), *found_links)
    out = rows.where("doc_id is not null and hi is not null").join(known, ["hi", "lo"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id", *found_links)
    none = [F.lit(0).cast("long").alias(c) for c in found_links]
    alone = rows.where("doc_id is null or hi is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), *none)
    return out.unionByName(alone)


def _common(rows: np.ndarray, shingles: np.ndarray, left: np.ndarray, right: np.ndarray, size: int) -> np.ndarray:
    """How many shingles each set of left has in common with each of right; sets are rows of (row, shingle)."""
    _, number, times = np.unique(shingles, return_inverse=True, return_counts=True)
    shared = times > 1  # the others are in one set only
    kept = shared[number]
    rows, number = rows[kept], (np.cumsum(shared) - 1)[number[kept]]
    order = np.argsort(number, kind="stable")
    rows, number = rows[order], number[order]
    out, at, columns = np.zeros((len(left), len(right)), np.float32), 0, int(shared.sum())
    for begin in range(0, columns, _WIDTH):
        width = min(_WIDTH, columns - begin)
        end = int(np.searchsorted(number, begin + width))
        m = np.zeros((size, width), np.float32)
        m[rows[at:end], number[at:end] - begin] = 1
        out += m[left] @ m[right].T
        at = end
    return out.astype(np.int64)


def _block_links(limit: Threshold, want: str):
    """Streams over sets sorted by (component, i, j): all links between blocks i and j of the component, counted or as pairs."""

    def links(held: list[tuple], inner: bool) -> tuple[np.ndarray, np.ndarray]:
        node, side, docs, sizes = (np.concatenate([h[k] for h in held]) for k in range(4))
        rows = np.repeat(np.arange(len(node)), sizes)
        left, right = (np.arange(len(node)),) * 2 if inner else (np.flatnonzero(~side), np.flatnonzero(side))
        common = _common(rows, np.concatenate([h[4] for h in held]), left, right, len(node))
        link = 100 * common >= limit.percent * (sizes[left][:, None] + sizes[right][None, :] - common)
        link &= node[left][:, None] != node[right][None, :]
        if want == "pairs":
            x, y = np.nonzero(np.triu(link) if inner else link)
            x, y = node[left[x]], node[right[y]]
            return np.minimum(x, y), np.maximum(x, y)
        degree = np.zeros(len(node), np.int64)
        degree[left] += link @ docs[right]
        if not inner:
            degree[right] += link.T @ docs[left]
        return node, degree

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b"] if want == "pairs" else ["node", "linked"]

        def batch_of(found):
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found]), pa.int64()) for k in range(2)], names=names)

        key, held, last = None, [], None
        for batch in batches:
            found = []
            part, i, j, node, side, docs = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(6))
            sizes, flat = batch.column(6).value_lengths().to_numpy().astype(np.int64), batch.column(6).flatten().to_numpy()
            if len(part):  # rows of one doc_id are neighbours; the first counts
                again = np.zeros(len(part), bool)
                again[1:] = (part[1:] == part[:-1]) & (i[1:] == i[:-1]) & (j[1:] == j[:-1]) & (node[1:] == node[:-1])
                again[0] = last == (part[0], i[0], j[0], node[0])
                last = (part[-1], i[-1], j[-1], node[-1])
                if again.any():
                    flat = flat[np.repeat(~again, sizes)]
                    part, i, j, node, side, docs, sizes = (c[~again] for c in (part, i, j, node, side, docs, sizes))
            ends = np.concatenate([[0], np.cumsum(sizes)])
            starts = [0, *(np.flatnonzero((part[1:] != part[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1).tolist()] if len(part) else []
            for x, y in zip(starts, [*starts[1:], len(part)], strict=True) if starts else []:
                now = (int(part[x]), int(i[x]), int(j[x]))
                if now != key and held:
                    found.append(links(held, key[1] == key[2]))
                    held = []
                key = now
                held.append((node[x:y], side[x:y], docs[x:y], sizes[x:y], flat[ends[x] : ends[y]]))
            if found:
                yield batch_of(found)
        if held:
            yield batch_of([links(held, key[1] == key[2])])

    return run


def _within(component: DataFrame, classes: DataFrame, sets: DataFrame, limit: Threshold, want: str) -> DataFrame:
    """All links within components: (node, linked), the doc_ids of the classes that a class is linked with, or the pairs (a, b).

    Each pair of sets of a component meets in one pair of blocks. Blocks are salted, so a component with a large part of all
    sets is many groups of bounded size, and only what is found leaves a group.
    """
    parts = int(component.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a doc_id may have several rows; it counts once, with the set whose hash is first
    docs = F.col("docs") if want == "links" else F.lit(1).cast("long")
    sizes = classes.groupBy(F.col("rep").alias("node")).agg(F.sum(docs).alias("docs"), F.sum("n").alias("n"))
    member = component.join(sizes, "node")
    blocks = member.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    member = materialize_few(member.join(blocks, "component").select("node", "component", "docs", "blocks", F.pmod(F.xxhash64("node"), "blocks").alias("block")), "members")
    # only sets of members are dealt; their ids are of a checked number, beyond it the join shuffles all sets
    dealt = sets.join(F.broadcast(member) if member.txscore_rows <= BROADCAST_NODES else member, "node")
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", (F.col("block") > F.col("other")).alias("side"), "docs", "s")
    dealt = dealt.repartition(parts, "component", "i", "j").sortWithinPartitions("component", "i", "j", "node", F.xxhash64("s"))
    found = dealt.mapInArrow(released(_block_links(limit, want)), "a long, b long" if want == "pairs" else "node long, linked long")
    return found if want == "pairs" else found.groupBy("node").agg(F.sum("linked").alias("linked"))


def _owned(large: DataFrame, component: DataFrame) -> DataFrame:
    return large.join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _passing(limit: Threshold):
    """Streams over entries sorted by shingle: each with the last of the RECENT before it that passes and has another component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, recent = None, deque(maxlen=RECENT)
        for batch in batches:
            t, node, part, n, pos, c1, c2 = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            a, b = [], []
            for k, v, c, size, at, cell in zip(t.tolist(), node.tolist(), part.tolist(), n.tolist(), pos.tolist(), _cells(c1, c2), strict=True):
                if k != token:
                    token = k
                    recent.clear()
                entry = (size, at, cell)
                for other in islice((r for r in recent if r[1] != c and _may_link(r[2], entry, limit)), 1):
                    a.append(min(v, other[0]))
                    b.append(max(v, other[0]))
                recent.appendleft((v, c, entry))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _likely(large: DataFrame, component: DataFrame, tested: DataFrame, limit: Threshold, turn: int) -> DataFrame | None:
    """Of each set, the untested pairs with other components that share most prefix shingles; TRIES at most, as a first try.

    None if there are none. What isn't tried here is left to _between().
    """
    spark = large.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = _owned(large, component).select("token", "node", "component", "n", "pos", "c1", "c2")
    mixed = own.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("token")
    own = own.join(mixed, "token").repartition(parts, "token").sortWithinPartitions("token", F.xxhash64("node", F.lit(turn)), "node")
    pairs = own.mapInArrow(released(_passing(limit)), "a long, b long").groupBy("a", "b").agg(F.count("*").alias("shared"))
    pairs = pairs.join(tested, ["a", "b"], "left_anti")
    best = Window.partitionBy("a").orderBy(F.desc("shared"), "b")
    pairs = materialize_few(pairs.withColumn("k", F.row_number().over(best)).where(F.col("k") <= TRIES).select("a", "b"), "tried")
    return None if pairs.isEmpty() else pairs


def _between(large: DataFrame, component: DataFrame, tested: DataFrame, limit: Threshold) -> DataFrame:
    """Untested pairs of different components that share a large bucket and pass the filters."""
    own = materialize_few(_owned(large, component), "owned")
    mixed = own.groupBy("token", "component").agg(F.count("*").alias("k")).groupBy("token").agg(F.max_by("component", F.struct("k", "component")).alias("top"), F.count("*").alias("parts")).where("parts > 1").select("token", "top")
    mixed = own.join(mixed, "token")
    y = mixed.select("token", *(F.col(c).alias(f"{c}_y") for c in ("node", "component", "n", "pos", "c1", "c2", "top")))
    x = mixed.where("component != top").select("token", *(F.col(c).alias(f"{c}_x") for c in ("node", "component", "n", "pos", "c1", "c2")))
    p, q = f"{limit.percent}", f"{100 + limit.percent}"
    need = f"ceil({p}.0D * (n_x + n_y) / {q})"
    byte = "abs((shiftrightunsigned({c}_x, {i}) & 255) - (shiftrightunsigned({c}_y, {i}) & 255))"
    each = [byte.format(c=c, i=8 * i) for c in ("c1", "c2") for i in range(8)]
    apart = " + ".join(f"least({d}, 256 - {d})" for d in each)
    # of two sets outside the largest component, only one order
    on = f"component_x != component_y and (component_y = top_y or node_x < node_y) and 100 * least(n_x, n_y) >= {p} * greatest(n_x, n_y) and least(n_x - pos_x, n_y - pos_y) >= {need} and pos_x + pos_y + {apart} <= n_x + n_y - 2 * {need}"
    pairs = x.join(y, "token").where(on).select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()
    return materialize_few(pairs.join(tested, ["a", "b"], "left_anti"), "rest")


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of near copies, the smallest doc_id; repeated rows of it are one.

    Documents without words and rows without a doc_id stay. All columns of docs are kept.
    """
    dropped = near_duplicates(docs.select("doc_id", "text"), n, percent).where("component_id != doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    dropped = materialize(dropped, "dropped")
    if dropped.count() <= BROADCAST_DROPPED:  # ids, so that documents aren't shuffled
        dropped = F.broadcast(dropped)
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    return plain.join(dropped, F.col(f"c{docs.columns.index('doc_id')}") == F.col("_gone"), "left_anti").toDF(*docs.columns)
