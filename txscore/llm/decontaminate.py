"""Benchmark decontamination by suffix arrays over shards of the training documents.

Every shard (a bounded run of documents in one task) becomes a sequence of word numbers with a suffix array over it.
The suffixes of the benchmark items are binary-searched in each shard: the windows give the intervals of places where
they occur, and every suffix its neighbours among the places, of which the longest common prefixes are the longest
verbatim matches, however long they are. Documents whose words lie in window occurrences enough go.

Only what can match is in the array: a place whose first three words (fewer for shorter items) begin no benchmark suffix
can't lie in its interval, and suffixes whose first three words aren't in the shard aren't searched in it. So matches of
fewer than LEAST words, which any text has, are not looked for, other than whole shorter items.

Items are cut into pieces of PIECE_WORDS words that overlap by a window, so that neither a long item nor many of them make
a large broadcast: pieces are dealt into blocks of about BLOCK_BYTES, each with a pass. Matches in neighbouring pieces of
an item are joined. Windows are kept once, and sets of items that share windows once, so passages that
thousands of items have in common cost a document no more than others.

Defined results: a null or empty text has no words and no hits, and is clean. Items without words match nothing, rows
without an item_id take no part, a repeated item_id counts once. Repeated documents are judged one by one. Other
columns of documents pass through untouched, whatever their names are. Of equally long matches the first in the document
is told. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txscore.llm._common import as_bytes, materialize, released, small_batches

WINDOW = 13
#: Of a document's words, the share (one in so many) from which on it counts as contaminated.
SHARE = 20
#: A broadcast block of benchmark texts holds about so many bytes; more items make more blocks, each with a pass.
BLOCK_BYTES = 16 << 20
PIECE_WORDS = 1 << 14
#: Words of a shard.
SHARD_WORDS = 1 << 18
#: Words of the shortest matches that are told, and of the keys that filter places.
LEAST = 3
_DEPTH = 16
#: Numbers of words: the end of an item, a word of no item or the end of a document, the first real one.
_END, _OTHER, _FIRST = 0, 1, 2
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z."""
    return text.translate(_TABLE).split() if text else []


class _Numbers(dict):
    def __missing__(self, word):
        return _OTHER


class TestIndex:
    """One block of pieces (item, first word's place in it, the item's words, text): its sorted suffixes and windows."""

    __test__ = False

    def __init__(self, pieces: list[tuple[int, int, int, bytes]], window: int = WINDOW):
        if not 1 <= window <= PIECE_WORDS:
            raise ValueError(f"window is {window}; it must be from 1 to {PIECE_WORDS}")
        self.vocab = _Numbers()
        parts, item_of, place_of, left, size_of = [], [], [], [], []
        for item, base, size, text in pieces:
            ids = [self.vocab.setdefault(w, len(self.vocab) + _FIRST) for w in words_of(text)]
            parts += [np.array(ids, np.int32), np.array([_END], np.int32)]
            n = len(ids)
            item_of.append(np.full(n + 1, item, np.int64))
            place_of.append(np.arange(base, base + n + 1))
            left.append(np.arange(n, -1, -1))
            size_of.append(np.full(n + 1, min(window, size), np.int64))
        none = np.zeros(0, np.int64)
        self.seq = np.concatenate([*parts, np.zeros(_DEPTH, np.int32)]).astype(np.int32)
        self.item, self.place, left, size = (np.concatenate(c) if c else none for c in (item_of, place_of, left, size_of))
        self.suffixes = _sorted_suffixes(self.seq[: len(self.item)], int(left.max(initial=0)))
        self._windows(left, size)
        heads = self.suffixes[left[self.suffixes] >= LEAST]
        #: the suffixes that matches are looked for of, in order
        self.suffixes = heads
        self.bits = {m: _bitmap(_heads(self.seq, p, m)) for m, p in {LEAST: heads, **{m: self.window_at[self.window_size == m] for m in range(1, LEAST)}}.items() if len(p)}

    def _windows(self, left: np.ndarray, size: np.ndarray) -> None:
        """The distinct windows: where one is, its size, and the number of the set of items that have it."""
        s = self.suffixes
        at = s[left[s] >= size[s]]
        at = at[(size[at] > 0)]
        by_size = [at[size[at] == m] for m in np.unique(size[at])]
        places, owners = [], []
        for group in by_size:
            m = int(size[group[0]])
            words = np.stack([self.seq[group + j] for j in range(m)], 1)
            new = np.ones(len(group), bool)  # sorted suffixes with one window are neighbours
            new[1:] = (words[1:] != words[:-1]).any(1)
            places.append(group[new])
            owners += np.split(self.item[group], np.flatnonzero(new)[1:])
        self.window_at = np.concatenate(places) if places else np.zeros(0, np.int64)
        self.window_size = size[self.window_at]
        known: dict[bytes, int] = {}
        self.owners: list[np.ndarray] = []
        self.owner_set = np.zeros(len(owners), np.int64)
        for k, o in enumerate(owners):
            o = np.unique(o)
            n = self.owner_set[k] = known.setdefault(o.tobytes(), len(known))
            if n == len(self.owners):
                self.owners.append(o)
        self.low = _keys(self.seq, self.window_at, np.minimum(self.window_size, _DEPTH), 0)
        self.high = _keys(self.seq, self.window_at, np.minimum(self.window_size, _DEPTH), 0xFFFFFFFF)


def _sorted_suffixes(seq: np.ndarray, longest: int) -> np.ndarray:
    """The places of seq's words in the order of their suffixes, by prefix doubling."""
    n = len(seq)
    if not n:
        return np.zeros(0, np.int64)
    rank, h = seq.astype(np.int64), 1
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[: max(0, n - h)] = rank[h:] + 1
        key = rank * (int(rank.max()) + 2) + ahead
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[0], (key[order][1:] != key[order][:-1]).astype(np.int64)])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        h *= 2
        if h > longest or int(rank[order[-1]]) == n - 1:
            return order[seq[order] >= _FIRST]


def _keys(x: np.ndarray, places: np.ndarray, sizes: np.ndarray | None = None, fill: int = 0) -> np.ndarray:
    """The _DEPTH words at each place as byte strings that sort in the same way; from `sizes` words on `fill`."""
    words = x[places[:, None] + np.arange(_DEPTH)].astype(">u4")
    if sizes is not None:
        words[np.arange(_DEPTH) >= sizes[:, None]] = fill
    return np.ascontiguousarray(words).view(f"S{4 * _DEPTH}").ravel()


_MIX = np.uint64(0x9E3779B97F4A7C15)


def _heads(x: np.ndarray, places: np.ndarray, m: int) -> np.ndarray:
    """A slot of 2^22 for the first m words at each place."""
    out = np.full(len(places), m, np.uint64)
    for j in range(m):
        out = (out ^ x[places + j].astype(np.uint64)) * _MIX
        out ^= out >> np.uint64(31)
    return (out >> np.uint64(42)).astype(np.int64)


def _bitmap(slots: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << 22, bool)
    out[slots] = True
    return out


def _common(x: np.ndarray, p: np.ndarray, y: np.ndarray, s: np.ndarray) -> np.ndarray:
    """The words that x from p on and y from s on have in common."""
    out = np.zeros(len(p), np.int64)
    on = np.arange(len(p))
    step = np.arange(_DEPTH)
    while len(on):
        b = y[(s[on] + out[on])[:, None] + step]
        same = (x[(p[on] + out[on])[:, None] + step] == b) & (b >= _FIRST)
        n = np.where(same.all(1), _DEPTH, same.argmin(1))
        out[on] += n
        on = on[n == _DEPTH]
    return out


class Shard:
    """The suffix array of a run of documents' words, over the places where a benchmark suffix can begin."""

    def __init__(self, words: np.ndarray, index: TestIndex):
        self.index = index
        self.x = np.concatenate([words, np.full(_DEPTH, _OTHER, np.int32)])
        n = len(words)
        maybe = np.zeros(n, bool)
        every = np.arange(n)
        self.seen: dict[int, np.ndarray] = {}
        for m, bits in index.bits.items():
            slots = _heads(self.x, every, m)
            here = bits[slots]
            maybe |= here
            self.seen[m] = _bitmap(slots[here & (words >= _FIRST)])
        places = np.flatnonzero(maybe & (words >= _FIRST))
        keys = _keys(self.x, places)
        order = np.argsort(keys, kind="stable")
        self.array, self.keys = places[order], keys[order]

    def _present(self, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Which of the benchmark's places begin with words that the shard has."""
        out = np.zeros(len(at), bool)
        for m, seen in self.seen.items():
            of = np.minimum(sizes, LEAST) == m
            out[of] = seen[_heads(self.index.seq, at[of], m)]
        return np.flatnonzero(out)

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(place, window) of all windows' occurrences: the windows' intervals of the array."""
        none = np.zeros(0, np.int64)
        index = self.index
        if not len(self.array):
            return none, none
        tried = self._present(index.window_at, index.window_size)
        lo, hi = np.searchsorted(self.keys, index.low[tried], "left"), np.searchsorted(self.keys, index.high[tried], "right")
        count = hi - lo
        found = np.flatnonzero(count > 0)
        count = count[found]
        at = np.repeat(lo[found] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        places, windows = self.array[at], np.repeat(tried[found], count)
        size = index.window_size[windows]
        if (size > _DEPTH).any():  # the array is sorted to _DEPTH words
            fine = _common(self.x, places, index.seq, index.window_at[windows]) >= size
            places, windows = places[fine], windows[fine]
        return places, windows

    def matches(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, words, benchmark place): the longest match from each place on, in the order of places."""
        index = self.index
        tried = self._present(index.suffixes, np.full(len(index.suffixes), LEAST)) if len(self.array) else np.zeros(0, np.int64)
        if not len(tried):
            return (np.zeros(0, np.int64),) * 3
        suffixes = index.suffixes[tried]
        keys = _keys(index.seq, suffixes)
        # every suffix's place in the array tells each place how many suffixes come before it
        after = np.searchsorted(np.searchsorted(self.keys, keys, "left"), np.arange(len(self.array)), "right")
        low = np.searchsorted(np.searchsorted(self.keys, keys, "right"), np.arange(len(self.array)), "right")
        # from low to after they share _DEPTH words with the place: those are searched by their further words
        deep = np.flatnonzero(after - low > 1)
        lo, hi = low[deep], after[deep]
        while len(deep) and (lo < hi).any():
            open_ = lo < hi
            middle = (lo + hi) // 2
            p, s = self.array[deep[open_]], suffixes[middle[open_]]
            n = _common(self.x, p, index.seq, s)
            less = index.seq[s + n] < self.x[p + n]
            lo[open_] = np.where(less, middle[open_] + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], middle[open_])
        after[deep] = lo
        best, of = np.zeros(len(self.array), np.int64), np.zeros(len(self.array), np.int64)
        for near in (after - 1, after):
            fine = np.flatnonzero((near >= 0) & (near < len(suffixes)))
            s = suffixes[near[fine]]
            n = _common(self.x, self.array[fine], index.seq, s)
            longer = n > best[fine]
            best[fine[longer]], of[fine[longer]] = n[longer], s[longer]
        order = np.argsort(self.array)
        order = order[best[order] >= LEAST]
        return self.array[order], best[order], of[order]


def _joined(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Matches (place, words, item, item's place) that no longer one of their item and distance holds; touching ones as one."""
    out, at = [], {}
    for place, n, item, start in sorted(found):
        k = at.get((item, place - start))
        if k is not None and out[k][0] + out[k][1] >= place:
            a, m, _, s = out[k]
            out[k] = a, max(m, place + n - a), item, s
        else:
            at[item, place - start] = len(out)
            out.append((place, n, item, start))
    return out


def _judge(shard: list[np.ndarray], test: TestIndex) -> list[tuple]:
    """Of each document: words, word spans of windows, items with windows, and longest matches."""
    sizes = np.array([len(d) for d in shard])
    begins = np.cumsum(sizes + 1) - sizes - 1
    flat = np.full(int((sizes + 1).sum()), _OTHER, np.int32)
    for d, b in zip(shard, begins, strict=True):
        flat[b : b + len(d)] = d
    array = Shard(flat, test)
    places, windows = array.windows()
    order = np.argsort(places, kind="stable")
    places, windows = places[order], windows[order]
    at, words, of = array.matches()
    if len(at):
        # a match that begins one word before holds this one
        start = np.ones(len(at), bool)
        start[1:] = (at[1:] != at[:-1] + 1) | (words[1:] >= words[:-1])
        at, words, of = at[start], words[start], of[start]
    cut, cut_m = np.append(np.searchsorted(places, begins), len(places)), np.append(np.searchsorted(at, begins), len(at))
    known: dict[tuple, tuple] = {}
    out = []
    for k, n in enumerate(sizes.tolist()):
        p, w = places[cut[k] : cut[k + 1]] - begins[k], windows[cut[k] : cut[k + 1]]
        items, spans = (), np.zeros((0, 2), np.int64)
        if len(p):
            sets = tuple(np.unique(test.owner_set[w]).tolist())
            if sets not in known:
                known[sets] = tuple(np.unique(np.concatenate([test.owners[s] for s in sets])).tolist())
            items, spans = known[sets], _union(np.stack([p, p + test.window_size[w]], 1))
        here = slice(cut_m[k], cut_m[k + 1])
        found = [(a - begins[k], m, test.item[s], test.place[s]) for a, m, s in zip(at[here], words[here], of[here], strict=True)]
        out.append((n, spans, items, _joined([tuple(map(int, f)) for f in found])))
    return out


def _union(spans: np.ndarray) -> np.ndarray:
    """Spans of which none touch, that cover the same words."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.ones(len(spans), bool)
    new[1:] = spans[1:, 0] > reach[:-1]
    return np.stack([spans[new, 0], reach[np.append(np.flatnonzero(new)[1:] - 1, len(spans) - 1)]], 1) if len(spans) else spans


def _scan(index, text_at: int, state: str | None, finish):
    """Judges the documents of batches; state names the column with the findings of blocks before, if there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = index.value
        number = test.vocab.__getitem__
        for batch in batches:
            found: list[tuple] = []
            shard: list[np.ndarray] = []
            held = 0
            for text in as_bytes(batch.column(text_at)):
                words = words_of(text)
                shard.append(np.fromiter(map(number, words), np.int32, len(words)))
                held += len(words)
                if held >= SHARD_WORDS:
                    found += _judge(shard, test)
                    shard, held = [], 0
            if shard:
                found += _judge(shard, test)
            if state:
                at = batch.schema.get_field_index(state)
                old = [pickle.loads(s) for s in batch.column(at).to_pylist()]
                found = [(n, _union(np.concatenate([a, s])), tuple(sorted({*b, *i})), _joined([*c, *m])) for (n, s, i, m), (_, a, b, c) in zip(found, old, strict=True)]
                batch = batch.remove_column(at)
            yield finish(batch, found)

    return released(run)


def _hit(spans: np.ndarray) -> int:
    return int((spans[:, 1] - spans[:, 0]).sum())


def _with_state(name: str):
    def finish(batch: pa.RecordBatch, found: list[tuple]) -> pa.RecordBatch:
        return batch.append_column(name, pa.array([pickle.dumps(f) for f in found], pa.binary()))

    return finish


def _clean(share: int):
    def finish(batch: pa.RecordBatch, found: list[tuple]) -> pa.RecordBatch:
        return batch.filter(pa.array([not _hit(s) or share * _hit(s) < n for n, s, _, _ in found], pa.bool_()))

    return finish


_MATCH = pa.struct([("start", pa.int64()), ("words", pa.int64()), ("item_id", pa.int64()), ("item_start", pa.int64())])
_OUT = [("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("longest_match", pa.int64()), ("longest_item", pa.int64()), ("longest_start", pa.int64()), ("longest_item_start", pa.int64()), ("matches", pa.list_(_MATCH))]
_OUT_SPARK = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_match long, longest_item long, longest_start long, longest_item_start long, matches array<struct<start: long, words: long, item_id: long, item_start: long>>"


def _digest(share: int):
    def finish(batch: pa.RecordBatch, found: list[tuple]) -> pa.RecordBatch:
        hit = [_hit(s) for _, s, _, _ in found]
        sha = [hashlib.sha256(",".join(sorted(map(str, i))).encode()).hexdigest() for _, _, i, _ in found]
        best = [min(m, key=lambda x: (-x[1], x), default=(None, 0, None, None)) for _, _, _, m in found]
        matches = [[dict(zip(("start", "words", "item_id", "item_start"), x, strict=True)) for x in m] for _, _, _, m in found]
        columns = [[f[0] for f in found], hit, [len(f[2]) for f in found], sha, [h > 0 and share * h >= f[0] for h, f in zip(hit, found, strict=True)], [b[1] for b in best], [b[2] for b in best], [b[0] for b in best], [b[3] for b in best], matches]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, kind) for v, (_, kind) in zip(columns, _OUT, strict=True))], names=["doc_id", *(c for c, _ in _OUT)])

    return finish


def _cut(window: int):
    """Items (item_id, text) to pieces of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                words = words_of(text)
                step = PIECE_WORDS - window + 1
                base = range(0, max(1, len(words) - window + 1), step)
                texts = [b" ".join(words[b : b + PIECE_WORDS]) for b in base]
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(texts), pa.int64()), pa.array(base, pa.int64()), pa.array([len(words)] * len(texts), pa.int64()), pa.array(texts, pa.binary())], names=["item", "base", "size", "words"])

    return run


def _scanned(docs: DataFrame, benchmark: DataFrame, window: int, finish, out) -> DataFrame:
    """One pass a block of the benchmark, each in one worker a task; the last one also finishes. Several passes write docs between."""
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text")).where("item_id is not null and text is not null")
    pieces = items.mapInArrow(_cut(window), "item long, base long, size long, words binary")
    total = pieces.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    dealt = pieces.withColumn("_block", F.pmod(F.xxhash64("item", "base", "words"), F.lit(blocks)))
    state = f"state_{uuid.uuid4().hex}"
    text_at = docs.columns.index("text")
    docs = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])  # Arrow functions take no names with dots
    schema = docs.schema
    for b in range(blocks):
        rows = dealt.where(F.col("_block") == b).collect()  # about BLOCK_BYTES
        index = spark.sparkContext.broadcast(TestIndex(sorted((r.item, r.base, r.size, bytes(r.words)) for r in rows), window))
        before = state if b else None
        if b < blocks - 1:
            docs = materialize(docs.mapInArrow(_scan(index, text_at, before, _with_state(state)), T.StructType([*schema.fields, T.StructField(state, T.BinaryType())])), "scanned")
    return docs.mapInArrow(_scan(index, text_at, before, finish), out or schema)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, the longest match with its places, and
    matches: from each place the longest match of LEAST words or more, unless it is the rest of the one before.
    """
    out = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {_OUT_SPARK}"
    return _scanned(docs.select("doc_id", "text"), benchmark, window, _digest(share), out)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """The documents that aren't contaminated, with all their columns; nothing is shuffled."""
    return _scanned(docs, benchmark, window, _clean(share), None).toDF(*docs.columns)
