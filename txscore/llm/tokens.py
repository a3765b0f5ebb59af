"""Token counts of whole texts under a unigram model, with the forward scores shared in a trie of pre-tokens.

Pieces are those of a SentencePiece vocabulary file, their scores log probabilities. A file of ranks (in which pieces were
merged, the frequent ones first) has none; there the probability of a rank is that of the Zipf-Mandelbrot law, 1 / (rank +
SHIFT), made to sum to 1. The best segmentation of a pre-token has the largest sum of scores, of equal ones the one
with fewer tokens. A pre-token is a word with the mark for a space before it. Each task
inserts its distinct pre-tokens in a trie. A node holds the best score and token count of the prefix that ends there,
computed once from its ancestors for all pre-tokens that share the prefix; the node where a pre-token ends so holds its
count, which is stored, and a text's count is a sum of stored counts.

A task's trie is started anew when it holds NODES nodes, and pre-tokens over LONG characters are counted along a plain
path, so memory is bounded whatever the texts are. The vocabulary, of fixed size, is broadcast. Nothing is shuffled.

Defined results: words are [^\\x20\\x09-\\x0D]+; white space itself is no token. Null and empty texts have 0 words and tokens.
A character that is no piece costs the least score less PENALTY and counts as its UTF-8 bytes, as byte fallback does.
Repeated rows are counted one by one. Other columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from txscore.llm._common import as_bytes, small_batches

#: The vocabulary file, a parameter of count_tokens; it is read where the driver runs.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
PENALTY = 10.0
#: The constant of the law of ranks that frequencies of words follow.
SHIFT = 2.7
NODES, LONG = 800_000, 256
SPACE = "▁"


def load_pieces(path: str = VOCABULARY) -> dict[str, float]:
    """The ordinary pieces of a vocabulary file with their scores; control, unknown and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = range(model.get_piece_size())
    pieces = {model.id_to_piece(k): model.get_score(k) for k in n if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k))}
    return log_probabilities(pieces)


def log_probabilities(pieces: dict[str, float]) -> dict[str, float]:
    """The scores, if they are log probabilities; whole numbers up to 0 are ranks, which get the law's.

    A pre-token has one mark for a space, so pieces with several are left out: files give them scores out of all order.
    """
    if not pieces or not all(s <= 0 and s == int(s) for s in pieces.values()):
        return pieces
    ranked = sorted((p for p in pieces if p.count(SPACE) < 2), key=lambda p: (-pieces[p], p))
    total = math.fsum(1 / (n + SHIFT) for n in range(1, len(ranked) + 1))
    return {p: -math.log((n + SHIFT) * total) for n, p in enumerate(ranked, 1)}


class Counter:
    """Counts of pre-tokens, kept in a trie."""

    def __init__(self, pieces: dict[str, float]):
        self.unknown = min(pieces.values(), default=0.0) - PENALTY
        self.longest = max(map(len, pieces), default=1)
        # the pieces read backwards, so that those that end at a place are found along one path; "" has a piece's score
        self.ends: dict = {}
        for piece, score in pieces.items():
            at = self.ends
            for char in reversed(piece):
                at = at.setdefault(char, {})
            at[""] = score
        self.known: dict[bytes, int] = {}
        self._clear()

    def _clear(self) -> None:
        self.known.clear()
        #: the child of a node by a character, under node << 21 | character
        self.child: dict[int, int] = {}
        self.score, self.tokens = [0.0], [0]

    def _best(self, text: str, at: int, score: list[float], tokens: list[int], nodes) -> tuple[float, int]:
        """The best (score, tokens) of text[:at + 1], where nodes[k] is the place of text[:k]'s in the lists."""
        best, least = -float("inf"), 0
        ends, k = self.ends.get(text[at]), at
        if ends is None or "" not in ends:
            before = nodes[at]
            best, least = score[before] + self.unknown, tokens[before] + len(text[at].encode("utf-8", "surrogatepass"))
        while ends is not None:
            piece = ends.get("")
            if piece is not None:
                before = nodes[k]
                total = score[before] + piece
                if total > best or total == best and tokens[before] + 1 < least:
                    best, least = total, tokens[before] + 1
            k -= 1
            if k < 0:
                break
            ends = ends.get(text[k])
        return best, least

    def count(self, word: bytes) -> int:
        found = self.known.get(word)
        if found is not None:
            return found
        text = SPACE + word.decode("utf-8", "replace")
        if len(text) > LONG:
            score, tokens, nodes = [0.0], [0], range(len(text) + 1)
            for at in range(len(text)):
                s, t = self._best(text, at, score, tokens, nodes)
                score.append(s)
                tokens.append(t)
            return tokens[-1]
        if len(self.score) >= NODES:
            self._clear()
        score, tokens, child = self.score, self.tokens, self.child
        node, path = 0, [0]
        for at, char in enumerate(text):
            key = node << 21 | ord(char)
            node = child.get(key)
            if node is None:
                s, t = self._best(text, at, score, tokens, path)
                node = child[key] = len(score)
                score.append(s)
                tokens.append(t)
            path.append(node)
        self.known[word] = tokens[node]
        return tokens[node]


def _count(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(sent.value)
        for batch in batches:
            words, tokens = [], []
            for text in as_bytes(batch.column(batch.schema.get_field_index("text"))):
                found = text.split() if text else []
                words.append(len(found))
                counts = list(map(counter.known.get, found))
                missing = [k for k, c in enumerate(counts) if c is None]
                for k in missing:
                    counts[k] = counter.count(found[k])
                tokens.append(sum(counts))
            doc = batch.column(batch.schema.get_field_index("doc_id"))
            yield pa.RecordBatch.from_arrays([doc, pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, path: str = VOCABULARY, pieces: dict[str, float] | None = None) -> DataFrame:
    """Per document: doc_id, n_words, n_tokens. pieces: a vocabulary given as it is, in place of a file."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(load_pieces(path) if pieces is None else pieces)
    return docs.select("doc_id", "text").mapInArrow(_count(sent), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_tokens long")
