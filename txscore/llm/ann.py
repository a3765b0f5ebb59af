"""Approximate nearest neighbours by inner product with a hierarchical k-means tree.

The tree is fitted on a bounded sample (SAMPLE_ROWS vectors, by the hash of vec_id) and broadcast; it has a leaf for each
LEAF_ROWS rows as long as a leaf has SAMPLED vectors of the sample. Every row is assigned to its leaf. Beyond
that the leaves are split further by Spark: in each, a tree of its own is fitted on a bounded sample of its rows, and rows
and queries that come to the leaf go on to the leaves of that tree. So a query meets leaves of about LEAF_ROWS rows whatever
the table's length is, until the two samples' leaves are used up (at some 300 million rows); then leaves grow.

A query walks a tree best bin first: it descends to the nearest child and puts the others in a priority
queue, from which it takes the nearest next, until it has visited enough leaves. How many are enough is calibrated:
for CALIBRATION queries the true neighbours among all rows and their leaves are found by brute force, and the visits
widen until the leaves visited hold RECALL of them.

To search by inner product, vectors get one more coordinate that makes them all as long as the longest, so that the
nearest by distance is the largest by product. A query meets the rows of its leaves; leaves are cut into chunks of about
CHUNK rows and only crowds of more than QUERIES queries into blocks, so a vector that a third of the rows share is no hot
task; a task holds one chunk and lets the queries pass by in batches. A query's k-th best among the sample's vectors in
its leaves is a bound below which chunks needn't report. Products that only choose candidates are of vectors scaled to
unit length, with a bound on their rounding, so the magnitude of vectors doesn't matter.

Defined results: vectors that are null, zero, of another length than most, or hold a null or non-finite component take no
part, nor do rows without a vec_id. Rows that repeat vec_id and vector count once; a query is never its own neighbour.
Rows with one vec_id and different vectors are candidates each, and as queries one query, whose rows are the best pairs of
vectors, so that a vec_id may be there more than once.
Ties go to the smaller vec_id. Other columns are left out. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from txscore.llm._common import hashed_sample, materialize, small_batches

SAMPLE_ROWS = 20_000
LEAF_ROWS, SAMPLED, BRANCHES = 256, 8, 8
#: Leaves with more than so many rows are split further, with trees fitted on about so many of their rows.
SPLIT_ROWS, REFINE_ROWS = 8 * LEAF_ROWS, 4096
CALIBRATION, RECALL = 200, 0.97
CHUNK, QUERIES = 2048, 1 << 16
_EPS = np.finfo(float).eps


def vectors_of(batch: pa.RecordBatch, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(vec_id, vectors in float64) of the rows that take part; all lengths must be `dim`, if it is given."""
    ids, column = batch.column(0), batch.column(1)
    keep, rows = [], []
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    for k, (i, n) in enumerate(zip(ids.to_pylist(), lengths.tolist(), strict=True)):
        if i is not None and n is not None and n == n and n == (dim or n) and n > 0:
            keep.append(k)
    if not keep:
        return np.zeros(0, np.int64), np.zeros((0, dim or 0))
    if dim is None:
        raise ValueError("dim is needed")
    taken = column.take(pa.array(keep))
    flat = taken.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(keep), dim)  # a null becomes NaN
    fine = np.isfinite(flat).all(1) & (flat != 0).any(1)
    rows = flat[fine]
    return np.array(ids.take(pa.array(keep)).to_pylist(), np.int64)[fine], rows


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row by row products, added in one order wherever the rows are."""
    return np.add.reduce(q * x, axis=1)


class Tree:
    """A k-means tree of a sample of `rows` rows. Vectors are given as they are and scaled by the longest's length."""

    def __init__(self, sample: np.ndarray, rows: int, longest: float, seed: int = 5):
        self.longest = longest
        #: rows that one vector of the sample stands for
        self.weight = rows / max(1, len(sample))
        self.centres: list[np.ndarray] = [np.zeros(sample.shape[1] + 1)]
        self.children: list[list[int]] = [[]]
        self.leaf: list[int] = [-1]
        self.leaves = 0
        self.sizes = [0]
        self._split(0, self.lifted(sample), self.weight, max(LEAF_ROWS, SAMPLED * self.weight), np.random.default_rng(seed))
        #: estimated rows of each leaf
        self.rows = np.zeros(self.leaves)
        for leaf, size in zip(self.leaf, self.sizes, strict=True):
            if leaf >= 0:
                self.rows[leaf] = size * self.weight
        self.stacked = [np.stack([self.centres[c] for c in kids]) if kids else None for kids in self.children]

    def lifted(self, x: np.ndarray) -> np.ndarray:
        x = x / self.longest
        return np.concatenate([x, np.sqrt(np.maximum(1 - (x * x).sum(1), 0))[:, None]], 1)

    def _split(self, node: int, x: np.ndarray, weight: float, least: float, chance) -> None:
        k = min(BRANCHES, int(np.ceil(len(x) * weight / least)))
        parts = _k_means(x, k, chance) if k > 1 else []
        if len(parts) < 2:
            self.leaf[node] = self.leaves
            self.sizes[node] = len(x)
            self.leaves += 1
            return
        for centre, members in parts:
            child = len(self.centres)
            self.centres.append(centre)
            self.children.append([])
            self.leaf.append(-1)
            self.sizes.append(0)
            self.children[node].append(child)
            self._split(child, members, weight, least, chance)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector, down the nearest centres."""
        x = self.lifted(x)
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
            elif len(rows):
                c = self.stacked[node]
                near = (-2 * x[rows] @ c.T + (c * c).sum(1)).argmin(1)
                todo += [(child, rows[near == k]) for k, child in enumerate(self.children[node])]
        return out

    def walk(self, q: np.ndarray, visits: int, least: int = 0) -> list[int]:
        """Leaves in best-bin-first order, `visits` of them and more until they hold `least` vectors of the sample."""
        q = np.append(q / lengths(q[None, :])[0], 0.0)
        queue, out, held = [(0.0, 0)], [], 0
        while queue and (len(out) < visits or held < least):
            node = heapq.heappop(queue)[1]
            while self.leaf[node] < 0:
                c = self.stacked[node]
                away = ((c - q) ** 2).sum(1)
                best = int(away.argmin())
                for k, child in enumerate(self.children[node]):
                    if k != best:
                        heapq.heappush(queue, (float(away[k]), child))
                node = self.children[node][best]
            out.append(self.leaf[node])
            held += self.sizes[node]
        return out


def _k_means(x: np.ndarray, k: int, chance, turns: int = 12) -> list[tuple[np.ndarray, np.ndarray]]:
    centres = x[chance.choice(len(x), min(k, len(x)), replace=False)]
    centres = np.unique(centres, axis=0)
    for _ in range(turns):
        near = (-2 * x @ centres.T + (centres * centres).sum(1)).argmin(1)
        present = np.unique(near)
        new = np.stack([x[near == j].mean(0) for j in present])
        if new.shape == centres.shape and np.allclose(new, centres, atol=1e-9):
            break
        centres = new
    near = (-2 * x @ centres.T + (centres * centres).sum(1)).argmin(1)
    return [(centres[j], x[near == j]) for j in np.unique(near)]


def lengths(x: np.ndarray) -> np.ndarray:
    """Row lengths without overflow or underflow of the squares."""
    top = np.abs(x).max(1, initial=0.0)
    top[top == 0] = 1.0
    return top * np.sqrt(((x / top[:, None]) ** 2).sum(1))


def _slack(dim: int) -> float:
    """More than what two products of vectors of unit length can differ by in whatever order they are added."""
    return 8 * (dim + 4) * _EPS


def _best(q_ids: np.ndarray, q: np.ndarray, least: np.ndarray | None, ids: np.ndarray, x: np.ndarray, k: int, longest: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, place in x, score) of each query's k nearest; only those that may reach least, if given.

    least is in the unit of rough products: of queries of length 1 and vectors of the longest's length 1.
    """
    slack = _slack(x.shape[1])
    rough = (q / lengths(q)[:, None]) @ (x / longest).T
    rough[q_ids[:, None] == ids[None, :]] = -np.inf
    if rough.shape[1] > k:
        bound = np.partition(rough, rough.shape[1] - k, 1)[:, rough.shape[1] - k] - slack
    else:
        bound = np.full(len(q), -np.finfo(float).max)
    if least is not None:
        bound = np.maximum(bound, least - slack)
    i, j = np.nonzero(rough >= np.maximum(bound, -np.finfo(float).max)[:, None])
    with np.errstate(over="ignore", invalid="ignore"):
        s = scores(q[i], x[j])
    order = np.lexsort((ids[j], -s, i))
    i, j, s = i[order], j[order], s[order]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    fine = rank < k
    return i[fine], j[fine], s[fine]


def _distinct(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    again = np.zeros(len(ids), bool)
    if len(np.unique(ids)) < len(ids):
        seen = set()
        for k, key in enumerate(zip(ids.tolist(), map(bytes, x), strict=True)):
            again[k] = key in seen
            seen.add(key)
    return ids[~again], x[~again]


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


_MET = pa.schema([("leaf", pa.int64()), ("part", pa.int64()), ("chunk", pa.int64()), ("block", pa.int64()), ("kind", pa.int32()), ("id", pa.int64()), ("least", pa.float64()), ("x", pa.list_(pa.float64()))])
_MET_SPARK = "leaf long, part long, chunk long, block long, kind int, id long, least double, x array<double>"
_ROW, _QUERY, _PROBE = 1, 2, 3


def _met(leaf, part, chunk, block, kind, ids, least, x) -> pa.RecordBatch:
    n = len(ids)
    whole = [np.broadcast_to(np.asarray(c, np.int64), n) for c in (leaf, part, chunk, block)]
    columns = [*map(pa.array, whole), pa.array(np.full(n, kind, np.int32)), pa.array(ids), pa.array(np.broadcast_to(np.asarray(least, float), n)), _lists(x)]
    return pa.RecordBatch.from_arrays(columns, schema=_MET)


def _deal(ids: np.ndarray, x: np.ndarray, chunks: np.ndarray) -> np.ndarray:
    """The chunk of each row, of its leaf's so many; by vec_id and vector, so repeated rows meet and others spread."""
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.ascontiguousarray(x[:, 0]).view(np.uint64)
    mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed ^ mixed >> np.uint64(32)) % chunks.astype(np.uint64)).astype(np.int64)


def _spread(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """0..n[0]-1, 0..n[1]-1, ... and whose turn each is."""
    whose = np.repeat(np.arange(len(n)), n)
    return whose, np.arange(len(whose)) - np.repeat(np.cumsum(n) - n, n)


def _rows(batch: pa.RecordBatch, dim: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    found = {c: batch.column(k).to_numpy(zero_copy_only=False) for k, c in enumerate(batch.schema.names) if c not in ("x", "tree")}
    return found, batch.column(batch.schema.names.index("x")).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _runs(*columns: np.ndarray) -> list[tuple[int, int]]:
    """The places where the rows' values change, as (begin, end)."""
    if not len(columns[0]):
        return []
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    at = np.flatnonzero(new)
    return list(zip(at.tolist(), [*at[1:].tolist(), len(new)], strict=True))


def _meet(dim: int, k: int, longest: float):
    """Rows and queries of a (leaf, part, chunk, block), rows first, to (query_id, vec_id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, x = None, np.zeros(0, np.int64), np.zeros((0, dim))
        held: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = 0
        for batch in batches:
            c, v = _rows(batch, dim)
            for a, b in _runs(c["leaf"], c["part"], c["chunk"], c["block"], c["kind"]):
                here = tuple(int(c[n][a]) for n in ("leaf", "part", "chunk", "block"))
                if here != key:
                    key, held, waiting = here, [], 0
                    ids, x = np.zeros(0, np.int64), np.zeros((0, dim))
                if c["kind"][a] == _ROW:
                    held.append((c["id"][a:b], v[a:b]))
                    waiting += b - a
                    if waiting < 2 * CHUNK:
                        continue
                if held:
                    ids, x = _distinct(np.concatenate([ids, *(i for i, _ in held)]), np.concatenate([x, *(w for _, w in held)]))
                    held, waiting = [], 0
                if c["kind"][a] == _QUERY and len(ids):
                    for at in range(a, b, 256):
                        end = min(b, at + 256)
                        i, j, s = _best(c["id"][at:end], v[at:end], c["least"][at:end], ids, x, k, longest)
                        if len(i):
                            yield pa.RecordBatch.from_arrays([pa.array(c["id"][at + i]), pa.array(ids[j]), pa.array(s)], names=["query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, every: int = 20, k: int = 20, recall: float = RECALL) -> DataFrame:
    """vectors (vec_id, embedding): for each vec_id divisible by `every` its k nearest as (query_id, rank, vec_id, score)."""
    spark = vectors.sparkSession
    small_batches(spark, 4000)
    sc = spark.sparkContext
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sizes = rows.where("vec_id is not null and size(embedding) > 0").groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not sizes:
        return none
    dim = sizes[0].n

    def measure(batches):
        n, longest = 0, 0.0
        for batch in batches:
            _, x = vectors_of(batch, dim)
            n, longest = n + len(x), max(longest, float(lengths(x).max(initial=0)))
        yield pa.RecordBatch.from_pydict({"n": [n], "longest": [longest]}, schema=pa.schema([("n", pa.int64()), ("longest", pa.float64())]))

    total, longest = rows.mapInArrow(measure, "n long, longest double").agg(F.sum("n"), F.max("longest")).first()
    if not total:
        return none
    sample = hashed_sample(rows, "vec_id", SAMPLE_ROWS, 3).toArrow()
    parts = [vectors_of(b, dim) for b in sample.to_batches()]
    sample_ids, sample_x = (np.concatenate(p) for p in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros((0, dim)))
    order = np.argsort(sample_ids, kind="stable")
    sample_ids, sample_x = _distinct(sample_ids[order], sample_x[order])
    grown = Tree(sample_x, total, longest)
    tree = sc.broadcast(grown)
    known = sc.broadcast((sample_ids, sample_x))
    visits, truth = _calibrated(rows, tree, dim, every, k, recall, longest)
    refined = grown.rows > SPLIT_ROWS if total > SAMPLE_ROWS else np.zeros(grown.leaves, bool)

    def visit(batches):
        own_ids, own = known.value
        own_leaf = tree.value.assign(own)
        scaled = (own / longest).T
        for batch in batches:
            ids, x = vectors_of(batch, dim)
            for at in range(0, len(ids), 256):
                i, q = ids[at : at + 256], x[at : at + 256]
                rough = (q / lengths(q)[:, None]) @ scaled
                same = i[:, None] == own_ids[None, :]
                rough[same] = -np.inf
                # k vectors of the sample in the leaves visited bound what those leaves' chunks must report
                walks = [tree.value.walk(v, visits, k + int(n)) for v, n in zip(q, same.sum(1), strict=True)]
                seen = np.zeros((len(q), tree.value.leaves), bool)
                for n, w in enumerate(walks):
                    seen[n, w] = True
                rough[~seen[:, own_leaf]] = -np.inf
                least = np.partition(rough, len(own_ids) - k, 1)[:, len(own_ids) - k] if len(own_ids) > k else np.full(len(q), -np.inf)
                # below a leaf that is split not all of its rows are met, so the bound holds for whole leaves only
                least = np.where([refined[w].any() for w in walks], -np.inf, least)
                r = np.repeat(np.arange(len(q)), list(map(len, walks)))
                yield _met(np.concatenate(walks), 0, 0, 0, _QUERY, i[r], np.maximum(least, -np.finfo(float).max)[r], q[r])

    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    queries = materialize(asked.mapInArrow(visit, _MET_SPARK).dropDuplicates(["leaf", "id", "x"]), "queries")
    crowd = np.zeros(grown.leaves, np.int64)
    for row in queries.groupBy("leaf").count().collect():  # one row a leaf, which the sample bounds
        crowd[row["leaf"]] = row["count"]
    shape = sc.broadcast((np.maximum(1, np.ceil(grown.rows / CHUNK)).astype(np.int64), np.maximum(1, np.ceil(crowd / QUERIES)).astype(np.int64)))

    def place(batches):
        chunks, blocks = shape.value
        for batch in batches:
            ids, x = vectors_of(batch, dim)
            if len(ids):
                leaf = tree.value.assign(x)
                copy, block = _spread(np.where(refined[leaf], 1, blocks[leaf]))
                yield _met(leaf[copy], 0, _deal(ids, x, np.where(refined[leaf], 1, chunks[leaf]))[copy], block, _ROW, ids[copy], 0.0, x[copy])

    def call(batches):
        """Sends each query to every chunk of its leaf, in one of its blocks."""
        chunks, blocks = shape.value
        for batch in batches:
            c, x = _rows(batch, dim)
            leaf = c["leaf"]
            copy, chunk = _spread(np.where(refined[leaf], 1, chunks[leaf]))
            block = _deal(c["id"], x, np.where(refined[leaf], 1, blocks[leaf]))
            yield _met(leaf[copy], 0, chunk, block[copy], _QUERY, c["id"][copy], c["least"][copy], x[copy])

    index, asking = rows.mapInArrow(place, _MET_SPARK), queries.mapInArrow(call, _MET_SPARK)
    both = index.unionByName(asking)
    if refined.any():
        both = _refined(index, asking, refined, grown, truth, crowd, dim, k, recall, longest)
    key = ["leaf", "part", "chunk", "block"]
    found = both.repartition(*key).sortWithinPartitions(*key, "kind").mapInArrow(_meet(dim, k, longest), "query_id long, vec_id long, score double")
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _refined(index: DataFrame, asking: DataFrame, refined: np.ndarray, grown: Tree, truth: pa.Table, crowd: np.ndarray, dim: int, k: int, recall: float, longest: float) -> DataFrame:
    """Sends the rows and queries of leaves that are split to the leaves of their own trees; the others stay as they are."""
    spark = index.sparkSession
    rate = spark.sparkContext.broadcast(np.minimum(1.0, REFINE_ROWS / np.maximum(1, grown.rows)))
    estimate = grown.rows

    def thin(batches):
        for batch in batches:
            c, x = _rows(batch, dim)
            leaf = c["leaf"]
            take = refined[leaf] & (_deal(c["id"], x, np.full(len(leaf), 1 << 20)) < rate.value[leaf] * (1 << 20))
            if take.any():
                yield _met(leaf[take], 0, 0, 0, _ROW, c["id"][take], 0.0, x[take])

    def fit(table: pa.Table) -> pa.Table:
        ids, x = _distinct(*(lambda c, x: (c["id"], x))(*_rows(table.combine_chunks().to_batches()[0], dim)))
        leaf = table["leaf"][0].as_py()
        return pa.table({"leaf": [leaf], "tree": [pickle.dumps(Tree(x, max(len(x), int(estimate[leaf])), longest))]}, schema=pa.schema([("leaf", pa.int64()), ("tree", pa.binary())]))

    trees = materialize(index.mapInArrow(thin, _MET_SPARK).dropDuplicates(["leaf", "id", "x"]).groupBy("leaf").applyInArrow(fit, "leaf long, tree binary"), "trees")
    # a leaf's rows and queries are dealt over tasks, each with a copy of its tree
    salts = {int(n): int(max(1, np.ceil((estimate[n] + crowd[n]) / (1 << 18)))) for n in np.flatnonzero(refined)}
    table = spark.createDataFrame(list(salts.items()), "leaf long, salts int")
    nothing = F.lit(None).cast("binary")
    sown = trees.join(F.broadcast(table), "leaf").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    sown = sown.select("leaf", F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("chunk"), F.lit(0).cast("long").alias("block"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("id"), F.lit(0.0).alias("least"), F.array().cast("array<double>").alias("x"), "tree", "salt")

    def dealt(df: DataFrame) -> DataFrame:
        salt = F.pmod(F.xxhash64("id", "x"), F.coalesce(F.col("salts"), F.lit(64))).cast("int")
        return df.join(F.broadcast(table), "leaf", "left").withColumn("salt", salt).drop("salts").withColumn("tree", nothing)

    pairs = truth.to_pylist()
    probes = [(r["leaf"], r["query_id"], n, [*r["q"], *r["x"]]) for n, r in enumerate(pairs) if refined[r["leaf"]]]

    def go(visits: int):
        def run(batches):
            here, own = None, None
            for batch in batches:
                leaves, kinds = batch.column(0).to_numpy(), batch.column(4).to_numpy()
                for a, b in _runs(leaves, kinds):
                    part, leaf, kind = batch.slice(a, b - a), int(leaves[a]), int(kinds[a])
                    if kind == 0:
                        here, own = leaf, pickle.loads(part.column(8)[0].as_py())
                        continue
                    if kind == _PROBE:
                        qx = part.column(7).flatten().to_numpy(zero_copy_only=False).reshape(-1, 2 * dim)
                        if here != leaf:
                            continue
                        at = own.assign(qx[:, dim:])
                        order = [own.walk(q, own.leaves).index(t) for q, t in zip(qx[:, :dim], at, strict=True)]
                        yield _met(leaf, np.array(order), 0, 0, _PROBE, part.column(5).to_numpy(), 0.0, qx)
                        continue
                    c, x = _rows(part.select(_MET.names), dim)
                    if here != leaf:
                        yield _met(leaf, 0, c["chunk"], c["block"], kind, c["id"], c["least"], x)
                        continue
                    chunks = np.maximum(1, np.ceil(own.rows / CHUNK)).astype(np.int64)
                    blocks = np.maximum(1, np.ceil(crowd[leaf] * max(visits, k // SAMPLED + 1) / own.leaves / QUERIES)).astype(np.int64)
                    if kind == _ROW:
                        bin_ = own.assign(x)
                        copy, block = _spread(np.full(len(x), blocks))
                        yield _met(leaf, 1 + bin_[copy], _deal(c["id"], x, chunks[bin_])[copy], block, kind, c["id"][copy], 0.0, x[copy])
                        continue
                    block = _deal(c["id"], x, np.full(len(x), blocks))
                    for at in range(0, len(x), 256):
                        walks = [own.walk(q, visits, 2 * k) for q in x[at : at + 256]]
                        r = at + np.repeat(np.arange(len(walks)), list(map(len, walks)))
                        bins = np.concatenate(walks)
                        copy, chunk = _spread(chunks[bins])
                        r, bins = r[copy], bins[copy]
                        yield _met(leaf, 1 + bins, chunk, block[r], kind, c["id"][r], c["least"][r], x[r])

        return run

    def sent(df: DataFrame) -> DataFrame:
        return df.repartition("leaf", "salt").sortWithinPartitions("leaf", "salt", "kind").drop("salt")

    visits = 1
    if probes:
        rows = [(leaf, 0, 0, 0, _PROBE, q, 0.0, x, None, n % salts[leaf]) for leaf, q, n, x in probes]
        asked = spark.createDataFrame(rows, f"{_MET_SPARK}, tree binary, salt int")
        order = np.sort([r.part for r in sent(sown.unionByName(asked)).mapInArrow(go(1), _MET_SPARK).where(f"kind = {_PROBE}").select("part").collect()])
        visits = 1 + int(order[min(len(order) - 1, int(np.ceil(recall * len(order))) - 1)])
    return sent(sown.unionByName(dealt(index)).unionByName(dealt(asking))).mapInArrow(go(visits), _MET_SPARK)


def exact(rows: DataFrame, asked: tuple[np.ndarray, np.ndarray], tree, dim: int, k: int, longest: float) -> DataFrame:
    """The true nearest of a bounded set of queries among all rows, with their leaves: (query_id, rank, vec_id, score, leaf, x)."""
    sent = rows.sparkSession.sparkContext.broadcast(asked)

    def against(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q = sent.value
        for batch in batches:
            ids, x = _distinct(*vectors_of(batch, dim))
            if len(ids):
                i, j, s = _best(q_ids, q, None, ids, x, k, longest)
                leaves = tree.value.assign(x) if tree is not None else np.zeros(len(x), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[i]), pa.array(ids[j]), pa.array(s), pa.array(leaves[j]), _lists(x[j])], names=["query_id", "vec_id", "score", "leaf", "x"])

    found = rows.mapInArrow(against, "query_id long, vec_id long, score double, leaf long, x array<double>")
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)


def _calibrated(rows: DataFrame, tree, dim: int, every: int, k: int, recall: float, longest: float) -> tuple[int, pa.Table]:
    """Leaf visits after which the calibration queries have this share of their true neighbours, and those with their leaves."""
    leaves = tree.value.leaves
    none = pa.table({"query_id": [], "leaf": [], "q": [], "x": []})
    if leaves == 1 and tree.value.rows.max() <= SPLIT_ROWS:
        return 1, none
    asked = hashed_sample(rows.where(F.pmod("vec_id", F.lit(every)) == 0), "vec_id", CALIBRATION, 9).toArrow()
    parts = [p for p in (vectors_of(b, dim) for b in asked.to_batches()) if len(p[0])]
    if not parts:
        return leaves, none
    q_ids, q = _distinct(*(np.concatenate(p) for p in zip(*parts, strict=True)))
    truth = exact(rows, (q_ids, q), tree, dim, k, longest).select("query_id", "leaf", "x").toArrow()  # k rows a query
    of = {i: n for n, i in enumerate(q_ids.tolist())}
    truth = truth.append_column("q", pa.array([q[of[i]].tolist() for i in truth["query_id"].to_pylist()], pa.list_(pa.float64())))
    at: dict[int, list[int]] = {}
    for query, leaf in zip(truth["query_id"].to_pylist(), truth["leaf"].to_pylist(), strict=True):
        at.setdefault(query, []).append(leaf)
    places = []
    for query, v in zip(q_ids.tolist(), q, strict=True):
        order = {leaf: n for n, leaf in enumerate(tree.value.walk(v, leaves))}
        places += [order[leaf] for leaf in at.get(query, [])]
    places = np.sort(np.array(places))
    visits = 1
    while visits < leaves and np.searchsorted(places, visits) < recall * len(places):
        visits += 1
    return visits, truth
