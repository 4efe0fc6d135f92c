"""Language-model scores by online logistic context mixing.

A text is its words (A-Z in lower case), each closed by a blank, then an end word. Symbols are coded bit by
bit along a Huffman tree. For every bit several predictors each look up a hashed context (the text's cluster with
orders 2, 3 and 5 within the word, the word so far, and the end of the word before with the beginning of
this one) in tables of counts taken from all training texts. A gated mixer adds the predictions in the
logistic domain: the gate, set by how often the word so far was met, picks the weights; a table refines
the result by how sure it is. Weights and table start neutral and learn online over the bits of all training words, one
occurrence of the word itself always left out of the counts that predict it. Clusters (in effect languages) are found
without labels, by k-means over the byte pairs of all training texts; a text pays for naming its own.

The bits of a word are mixed with the share of the whole word among its cluster's training words, in the proportion
of words that training leaves unseen (Good and Turing). Along the text a second gate then learns online, after every
phrase, to weigh three experts: that mixture, the bits alone, and what followed the same four words in other
training texts. Phrases end where the hash of the last four words says so, 16 words apart on average, so they are cut
alike wherever they stand; a training text is never predicted by itself.

What is gathered grows with the corpus: counts of all words by cluster and of all phrases lie in a table that texts are
joined to. Only the shares of at most HEAD frequent words are broadcast, with the predictors' tables of SLOTS counts;
a score doesn't depend on how many.

The bits of a word depend only on the word, its cluster, the end of the word before and the model, so they are
taken once in a worker and kept. (Letting weights learn on after every bit of every text costs over 2000
CPU seconds a GB; the README has figures for both.)
"""

from __future__ import annotations

import heapq
import uuid
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: The most words whose counts are broadcast.
HEAD = 250_000
#: Bytes of text that run together, and words whose bits a worker keeps.
CHUNK = 1_500_000
KEPT = 300_000
#: log2 of the beginnings of words, with what stands ahead, whose bits a worker keeps.
PAIR_SLOTS = 20
#: The mixer learns from so many words at once, in one task for LEARN_WORDS distinct words.
LEARN_ROWS, LEARN_WORDS = 5_000, 100_000
#: log2 of the slots of each predictor: orders 2, 3, 5, the word so far, across words.
SLOTS = (19, 20, 21, 22, 19)
BLOCK = 1 << 16
#: The end word: a byte that no UTF-8 text holds.
END = b"\xff"
INPUTS, ORDERS, SO_FAR, ACROSS = len(SLOTS), (2, 3, 5), 3, 4
GATES = 8
LEVELS = np.array([1, 2, 4, 16, 128, 1024])
#: Every weight to begin with.
NEUTRAL = 0.25
RATE, REFINE_RATE = 0.02, 0.02
BUCKETS = 24
#: Clusters of texts, byte pairs by hash that they are found with, rounds over all texts, random starts, and the rounds after which the
#: worse half of the starts is dropped.
CLUSTERS, PAIRS, ROUNDS, STARTS, HALVED = 8, 128, 6, 10, 1
#: Weight of the whole corpus in a cluster's shares.
SMOOTH = 200.0
#: Distinct training words that one task turns into counts of contexts.
WORDS_A_TASK = 1_000_000
#: A phrase ends after one word in PHRASE; weights of the experts (mixture, bits, phrases) that each text starts from, and how
#: fast they learn.
PHRASE = 32
EXPERTS, GATE_RATE = (0.9, 0.02, 0.08), 2.0
#: Phrases (and words ahead of them) of which at most so many are broadcast, those that occur most.
PHRASES_BROADCAST = 200_000


class Code(NamedTuple):
    length: np.ndarray  # symbol
    node: np.ndarray  # symbol x depth
    bit: np.ndarray


def huffman(counts: np.ndarray) -> Code:
    """Paths of all 256 symbols, each counted once more than met."""
    heap = [(int(c) + 1, s, s) for s, c in enumerate(counts)]
    heapq.heapify(heap)
    children, fresh = {}, 256
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        children[fresh] = (a[2], b[2])
        heapq.heappush(heap, (a[0] + b[0], fresh, fresh))
        fresh += 1
    paths, open_ = {}, [(fresh - 1, [])]
    while open_:
        at, path = open_.pop()
        if at < 256:
            paths[at] = path
        else:
            open_ += [(child, [*path, (at - 256, side)]) for side, child in enumerate(children[at])]
    deep = max(map(len, paths.values()))
    node, bit = np.zeros((256, deep), np.uint32), np.zeros((256, deep), np.int8)
    for s, path in paths.items():
        for k, (n, b) in enumerate(path):
            node[s, k], bit[s, k] = n, b
    return Code(np.array([len(paths[s]) for s in range(256)]), node, bit)


_K = np.uint32(0x9E3779B1)
_CLUSTER = np.uint32(0x7FEB352D)


def contexts(data: np.ndarray, cluster: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """Context hashes (predictor x symbol) of words that are each closed by a blank, with the cluster of each symbol.

    ``before``: the last two bytes ahead of each word as one number; by default those of the word ahead."""
    blank = data == 32
    n = len(data)
    place = np.arange(n)
    start = np.zeros(n, np.int64)
    start[1:][blank[:-1]] = place[1:][blank[:-1]]
    np.maximum.accumulate(start, out=start)
    inside = place - start
    out = np.empty((INPUTS, n), np.uint32)
    salt = (cluster.astype(np.uint32) + np.uint32(1)) * _CLUSTER
    rolling = np.zeros(n, np.uint32)
    padded = np.concatenate((np.full(5, 32, np.uint8), data))
    bytes_back = {}
    for k in range(1, 6):
        bytes_back[k] = np.where(inside >= k, padded[5 - k : 5 - k + n], 32).astype(np.uint32)
        rolling = (rolling + bytes_back[k] + np.uint32(1)) * _K
        if k in ORDERS:
            out[ORDERS.index(k)] = rolling ^ (rolling >> np.uint32(15)) ^ salt
    up, down = C._grown(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(C.BYTE_VALUE[data] * up[:n], out=total[1:])
    out[SO_FAR] = (C.mixed((total[place] - total[start]) * down[start] + inside.astype(np.uint64)) >> np.uint64(32)).astype(np.uint32) ^ salt
    first = data[start].astype(np.uint32)
    second = data[np.minimum(start + 1, n - 1)].astype(np.uint32)
    if before is None:
        back = lambda k: np.where(start >= k, padded[np.maximum(start + 5 - k, 0)], 0).astype(np.uint32)
        ahead = back(2) | back(3) << np.uint32(8)
    else:
        ahead = before
    early = np.where(inside == 0, ahead, ahead | (first + np.uint32(1)) << np.uint32(16)) * _K
    late = ((first | second << np.uint32(8) | bytes_back[1] << np.uint32(16)) + np.uint32(0x5000_0000)) * _K
    mixed = np.where(inside < 2, early, late)
    out[ACROSS] = mixed ^ (mixed >> np.uint32(13)) ^ salt
    return out


def bits(data: np.ndarray, code: Code, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many bits each symbol has (none but those of ``only``), and for each bit the node and the bit."""
    length = code.length[data] if only is None else np.where(only, code.length[data], 0)
    path = np.arange(int(length.sum())) + np.repeat(data.astype(np.int64) * code.node.shape[1] - (np.cumsum(length) - length), length)
    return length, code.node.ravel().take(path), code.bit.ravel().take(path)


def slots(context: np.ndarray, node: np.ndarray, predictor: int) -> np.ndarray:
    mixed = (context + node * np.uint32(0x85EBCA6B)) * np.uint32(0xC2B2AE35)
    return mixed >> np.uint32(32 - SLOTS[predictor])


_OFFSETS = np.concatenate(([0], np.cumsum([1 << s for s in SLOTS])))


def packed(counts: np.ndarray) -> np.ndarray:
    """Counts in a byte each: exact up to 127, beyond that in sixths of a power of two."""
    large = 128 + np.minimum(127, np.floor(6 * np.log2(np.maximum(counts, 128) / 128)))
    return np.where(counts < 128, counts, large).astype(np.uint8)


UNPACKED = np.concatenate((np.arange(128.0), 128 * 2 ** ((np.arange(128) + 0.5) / 6)))


def logits(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return np.where(zeros + ones > 0, np.log((ones + 0.05) / (zeros + 0.05)), 0).astype(np.float32)


# of a slot's two counts, packed, as one number: its logit and level, as it is and without one bit 0 or 1
_ZEROS, _ONES = UNPACKED[np.arange(1 << 16) & 255], UNPACKED[np.arange(1 << 16) >> 8]
LOGIT = [logits(_ZEROS, _ONES), logits(np.maximum(_ZEROS - 1, 0), _ONES), logits(_ZEROS, np.maximum(_ONES - 1, 0))]
LOGIT_LEFT_OUT = np.concatenate(LOGIT[1:])  # by the bit that is left out, and the counts
LEVEL = [np.searchsorted(LEVELS, n, side="right").astype(np.int8) for n in (_ZEROS + _ONES, np.maximum(_ZEROS + _ONES - 1, 0))]


class Tables(NamedTuple):
    code: Code
    counts: np.ndarray  # of each slot, by predictor: times 0 and times 1, packed


class Model(NamedTuple):
    name: str
    tables: Tables
    weights: np.ndarray  # gate x predictor
    refine: np.ndarray  # gate x bucket
    centres: np.ndarray  # cluster x byte pairs
    head: np.ndarray  # hashes of the frequent words, by place
    base: np.ndarray  # log10 of their base probabilities
    rest: np.ndarray  # (word, the end word last) x cluster: log of their bits after the first two symbols, nan if not taken
    shares: np.ndarray  # (word, the end word last) x cluster: log of their smoothed shares
    sizes: np.ndarray  # smoothed training words of each cluster
    everything: float  # training tokens, 1 at least
    end: float
    end_known: bool
    unknown: float
    whole: float  # share of the whole words' expert
    least: int | None  # words met so often are frequent


def tokens(texts: list[str | None]) -> list[list[bytes]]:
    """Words of each text and the end word."""
    return [[*(t or "").encode().lower().split(), END] for t in texts]


def neighbours(words: list[list[bytes]]) -> np.ndarray:
    """For each word the last two bytes ahead of it and its own first two (with its blank) as one number."""
    raw = np.frombuffer(b" " + END + b" " + b"".join(b" ".join(w) + b" " for w in words), np.uint8)
    ends = np.flatnonzero(raw == 32)[1:]
    ahead, start = ends[:-1], ends[:-1] + 1
    return raw[ahead - 1].astype(np.uint32) | raw[ahead - 2].astype(np.uint32) << np.uint32(8) | raw[start].astype(np.uint32) << np.uint32(16) | raw[start + 1].astype(np.uint32) << np.uint32(24)


def shared(own: np.ndarray, total: np.ndarray, sizes: np.ndarray, everything: float) -> np.ndarray:
    """Log of the smoothed shares (word x cluster) of words with these counts."""
    return np.log((own + SMOOTH * total[:, None] / everything) / sizes)


# clusters --------------------------------------------------------------------------------------------------------------


def byte_pairs(texts: list[str | None]) -> np.ndarray:
    """Of each text the roots of its shares of byte pairs, by hash, in 255ths."""
    out = np.zeros((len(texts), PAIRS), np.uint8)
    for row, text in zip(out, texts):
        raw = np.frombuffer((text or "").encode().lower(), np.uint8)
        if len(raw) > 1:
            met = np.bincount((raw[:-1] * np.uint8(37) ^ raw[1:] * np.uint8(101)) % np.uint8(PAIRS), minlength=PAIRS)
            row[:] = np.rint(255 * np.sqrt(met / (len(raw) - 1)))
    return out


def nearest(pairs: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Number of the centre with the largest cosine, the first of equals."""
    return (pairs.astype(np.float32) @ centres.T).argmax(axis=1)


def _unit(x: np.ndarray) -> np.ndarray:
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def clustered(documents: DataFrame, text_col: str = "text") -> np.ndarray:
    """Centres of the texts' byte pairs by spherical k-means over all texts. Random texts are the first centres of STARTS starts;
    every round assigns every text, on the executors, for all starts that are left, and only sums reach the driver. What a
    start is worth is the cosine of all texts with their centres."""

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in byte_pairs(C.texts(part, "text"))], pa.binary())], names=["pairs"])

    rows = C.stored(C.small_batches(documents).select(F.col(text_col).alias("text")).mapInArrow(taken, "pairs binary"))
    rows = rows.where(F.col("pairs") != F.lit(bytes(PAIRS)))
    low = rows.select(F.xxhash64("pairs").alias("h"), "pairs").mapInArrow(_lowest, "h bigint, pairs binary").collect()
    first = [pairs for _, pairs in sorted({(r["h"], bytes(r["pairs"])) for r in low})[: STARTS * CLUSTERS]]
    if not first:
        return np.zeros((1, PAIRS), np.float32)
    unit = _unit(np.frombuffer(b"".join(first), np.uint8).reshape(-1, PAIRS).astype(float))
    if len(first) < STARTS * CLUSTERS:
        starts = [unit[np.random.default_rng(seed).permutation(len(unit))[:CLUSTERS]] for seed in range(STARTS)]
    else:
        starts = list(unit.reshape(STARTS, CLUSTERS, PAIRS))
    for done in range(1, ROUNDS + 1):
        many = len(starts[0])
        total = np.zeros((len(starts), many, PAIRS + 1), np.int64)
        for r in rows.mapInArrow(_assigned(np.array(starts)), "total binary").collect():
            total += np.frombuffer(r["total"], np.int64).reshape(total.shape)
        after = [np.where(t.any(axis=1, keepdims=True), _unit(t), c).astype(np.float32) for t, c in zip(total[:, :, :-1], starts)]  # an empty cluster keeps its centre
        same = all((a == c).all() for a, c in zip(after, starts))
        starts = after
        if same or done % HALVED == 0:
            worth = total[:, :, -1].sum(axis=1)
            starts = [starts[k] for k in sorted(np.argsort(-worth, kind="stable")[: 1 if same else max(1, len(starts) // 2)])]
        if same:
            break
    return starts[0]


def _assigned(starts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each cluster of each start the sum of its texts' byte pairs and, behind it, of their cosines in 2**18ths."""
        count, many, _ = starts.shape
        total, centres = np.zeros((count * many, PAIRS + 1), np.int64), starts.reshape(-1, PAIRS).T.copy()
        for batch in batches:
            for begin in range(0, batch.num_rows, 10_000):  # sums of so many bytes are exact in a float
                pairs = np.frombuffer(b"".join(batch.column("pairs").slice(begin, 10_000).to_pylist()), np.uint8).reshape(-1, PAIRS).astype(np.float32)
                dots = (pairs @ centres).reshape(len(pairs), count, many)
                own = (dots.argmax(axis=2)[:, :, None] == np.arange(many)).reshape(len(pairs), -1)
                total[:, :-1] += (own.astype(np.float32).T @ pairs).astype(np.int64)
                total[::many, -1] += (dots.max(axis=2) * 1024).astype(np.int64).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

    return run


def _lowest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct rows (h, pairs) of the lowest hashes, as many as all starts need."""
    kept: dict[int, bytes] = {}
    for batch in batches:
        found, at = np.unique(batch.column("h").to_numpy(), return_index=True)
        kept |= zip(found[: STARTS * CLUSTERS].tolist(), batch.column("pairs").take(pa.array(at[: STARTS * CLUSTERS])).to_pylist())
        kept = dict(sorted(kept.items())[: STARTS * CLUSTERS])
    yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.int64()), pa.array(list(kept.values()), pa.binary())], names=["h", "pairs"])


# phrases ---------------------------------------------------------------------------------------------------------------

_CONTEXT = [np.uint64(pow(0x9FB21C651E98DF25, k + 1, 2**64)) for k in range(4)]
_START, _LAST = np.uint64(0x2545F4914F6CDD1D), np.uint64(0xD1342543DE82EF95)


def hashes(split: list[list[bytes]]) -> np.ndarray:
    """Hashes of the texts' words, their end words left out."""
    return C.word_hashes(b" ".join([b" ".join(own[:-1]) for own in split]))


class Cut:
    """The words of some texts as places in their bytes. Two words of 64-bit hashes count as the same if these are."""

    def __init__(self, texts: list[str | None]):
        raw = [(t or "").encode() for t in texts]
        self.data = b"\n".join(raw).lower()
        self.hashes, self.starts, self.ends = C.words(self.data)
        limits = np.cumsum([len(r) + 1 for r in raw])
        self.text = np.searchsorted(limits, self.starts, side="right")  # of each word
        self.own = np.bincount(self.text, minlength=len(raw))
        self.lengths = self.own + 1  # with the end word
        self.place = np.arange(len(self.text)) + self.text  # of each word among all words and end words
        self.last = np.cumsum(self.lengths) - 1  # of each end word

    def word(self, k: int) -> bytes:
        return self.data[self.starts[k] : self.ends[k]]

    def spread(self, of_words, of_ends, kind) -> np.ndarray:
        """Values of words and of end words in the order of the texts."""
        out = np.empty(len(self.place) + len(self.last), kind)
        out[self.place], out[self.last] = of_words, of_ends
        return out

    def neighbours(self) -> np.ndarray:
        """As ``neighbours`` of the words."""
        raw, long = np.frombuffer(self.data, np.uint8), self.ends - self.starts > 1
        first, second = raw[self.starts], np.where(long, raw[np.minimum(self.starts + 1, len(raw) - 1)] if len(raw) else 0, 32)
        back, before = raw[self.ends - 1], np.where(long, raw[self.ends - 2] if len(raw) > 1 else 0, 32)
        first, second, back, before = (self.spread(x, e, np.uint32) for x, e in ((first, END[0]), (second, 32), (back, END[0]), (before, 32)))
        ahead = np.concatenate(([END[0] | 32 << 8], back[:-1] | before[:-1] << np.uint32(8))).astype(np.uint32)
        return ahead | first << np.uint32(16) | second << np.uint32(24)


def phrases(words: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrases of texts with so many words (``own``) of these hashes, in order, each as (hash of the four words ahead, hash of its
    own words); the number of words of its text, the end word included, up to each phrase's end; and how many each text
    has. A text's last phrase has its end."""
    last = np.cumsum(own)
    first = np.repeat(last - own, own)  # of each word: place of its text's first
    place = np.arange(len(words))
    cut = np.zeros(len(words) + 1, bool)  # whether a phrase ends after so many words
    context = np.zeros(len(words), np.uint64)
    if len(words) >= 4:
        context[3:] = C.mixed(sum(words[3 - k : len(words) - k] * _CONTEXT[k] for k in range(4)))
        cut[1:] = (context % np.uint64(PHRASE) == 0) & (place - first >= 3)
    ends = np.flatnonzero(cut)
    text = np.searchsorted(last, ends - 1, side="right")
    order = np.argsort(np.concatenate((text, np.arange(len(own)))), kind="stable")  # each text's own ends, then its last
    text = np.concatenate((text, np.arange(len(own))))[order]
    closing = np.concatenate((np.zeros(len(ends), bool), np.ones(len(own), bool)))[order]
    stops = np.concatenate((ends, last))[order]
    many = np.bincount(text, minlength=len(own))
    opening = np.zeros(len(stops), bool)
    opening[np.cumsum(many) - many] = True
    starts = np.where(opening, (last - own)[text], np.concatenate(([0], stops[:-1])))
    up, down = C._grown(len(words) + 1)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=total[1:])
    content = C.mixed((total[stops] - total[starts]) * down[starts] + (stops - starts).astype(np.uint64))
    content[closing] ^= _LAST
    ahead = np.where(opening, _START, context[np.maximum(starts - 1, 0)] if len(words) else _START)
    return np.column_stack((ahead, content)), stops - (last - own)[text] + closing, many


# counting --------------------------------------------------------------------------------------------------------------


def _word_counts(centres: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (kind, key, cluster, n): 0 words, 1 neighbours, 2 texts, 3 phrases."""
        _SPELLERS.clear()  # of models fitted before
        counts, pairs, number = [Counter() for _ in centres], [], 0

        def rows(kind, keys, n, cluster=0):
            columns = [pa.array([kind] * len(keys), pa.int32()), pa.array(keys, pa.binary()), pa.array([cluster] * len(keys), pa.int32()), pa.array(n, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["kind", "key", "cluster", "n"])

        def merged(found):
            keys, n = np.concatenate([p[0] for p in found]), np.concatenate([p[1] for p in found])
            unique, at = np.unique(keys, return_inverse=True)
            return unique, np.bincount(at, n).astype(np.int64)

        def words():
            for cluster, own in enumerate(counts):
                if own:
                    yield rows(0, list(own), list(own.values()), cluster)
                own.clear()

        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                texts = C.texts(batch.slice(begin, 500), "text")
                cut, of = Cut(texts), nearest(byte_pairs(texts), centres)
                number += len(texts)
                for c in np.unique(of):
                    counts[c].update(b" ".join([(texts[k] or "").encode() for k in np.flatnonzero(of == c)]).lower().split())
                pairs.append(np.unique(cut.neighbours().astype(np.uint64) | np.repeat(of.astype(np.uint64) << np.uint64(32), cut.lengths), return_counts=True))
                if len(pairs) > 32:
                    pairs[:] = [merged(pairs)]
                said, n = np.unique(phrases(cut.hashes, cut.own)[0].astype(">u8").view("S16").ravel(), return_counts=True)
                yield rows(3, pa.array(_padded(said), pa.binary()), n)
                if sum(map(len, counts)) > 300_000:
                    yield from words()
        yield from words()
        if pairs:
            keys, n = merged(pairs)
            cluster = (keys >> np.uint64(32)).astype(np.int32)
            for c in np.unique(cluster):
                yield rows(1, [int(k).to_bytes(4, "little") for k in (keys[cluster == c] & np.uint64(0xFFFFFFFF))], n[cluster == c], int(c))
        yield rows(2, [b""], [number])

    return run


def _padded(keys: np.ndarray) -> pa.Array:
    """Bytes of 16 each, with the zeros at their ends that numpy drops."""
    size = np.arange(0, 16 * len(keys) + 1, 16, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(size), pa.py_buffer(np.ascontiguousarray(keys).tobytes())])


class Counts(NamedTuple):
    table: DataFrame  # kind, key, n, by_cluster
    centres: np.ndarray
    texts: int
    tokens: int
    distinct: int


def count(documents: DataFrame, trained: Column, id_col: str = "doc_id", text_col: str = "text") -> Counts:
    """Counts over all training texts, on the executors; only totals reach the driver."""
    own = documents.where(trained)
    centres = clustered(own, text_col)
    rows = C.small_batches(own).select(F.col(text_col).alias("text")).mapInArrow(_word_counts(centres), "kind int, key binary, cluster int, n bigint")
    by_cluster = F.array(*(F.sum(F.when(F.col("cluster") == k, F.col("n")).otherwise(0)) for k in range(len(centres))))
    table = C.stored(rows.groupBy("kind", "key").agg(F.sum("n").alias("n"), by_cluster.alias("by_cluster")))
    total = {r["kind"]: r for r in table.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).collect()}
    texts = total[2]["n"] if 2 in total else 0
    words = total.get(0)
    return Counts(table, centres, texts, (words["n"] if words else 0) + texts, (words["rows"] if words else 0) + (texts > 0))


def _spelled(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of words that are each closed by a blank, whether a byte is one of a word's first two, and whose it is."""
    data = np.frombuffer(b" ".join(words) + b" ", np.uint8)
    early = np.ones(len(data), bool)
    early[2:] = (data[1:-1] == 32) | (data[:-2] == 32)
    return data, early, np.repeat(np.arange(len(words)), [len(w) + 1 for w in words])


def _paired(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of neighbours: bytes of the words' beginnings (closed by a blank), the ends ahead, which bytes count, and
    whose they are."""
    back, first, second = keys & np.uint32(0xFFFF), keys >> np.uint32(16) & np.uint32(255), keys >> np.uint32(24)
    keep = np.column_stack((np.ones((len(keys), 2), bool), second != 32))
    data = np.column_stack((first, second, np.full(len(keys), 32))).astype(np.uint8)[keep]
    counted = np.column_stack((np.ones((len(keys), 2), bool), np.zeros(len(keys), bool)))[keep]
    owner = np.repeat(np.arange(len(keys)), 3).reshape(-1, 3)[keep]
    return data, np.column_stack([back] * 3)[keep], counted, owner


def _counted(counts: np.ndarray, data: np.ndarray, cluster: np.ndarray, weight: np.ndarray, late: np.ndarray | None, code: Code, which, before=None) -> None:
    """Add the weighted bits of the symbols to counts (slot x bit). ``late`` is the weight for the last predictor."""
    hashes = contexts(data, cluster, before)
    length, node, bit = bits(data, code, weight > 0)
    side = bit.astype(np.uint32)
    for k in which:
        own = np.repeat((late if late is not None and k == ACROSS else weight).astype(np.float32), length)
        at = slots(np.repeat(hashes[k], length), node, k)
        np.add.at(counts[_OFFSETS[k] : _OFFSETS[k + 1]].reshape(-1), at << np.uint32(1) | side, own)


def _rows(batch: pa.RecordBatch, begin: int, size: int) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    part = batch.slice(begin, size)
    kind, key, cluster, n = (part.column(c) for c in ("kind", "key", "cluster", "n"))
    return kind.to_numpy(), key.to_pylist(), cluster.to_numpy(), n.to_numpy().astype(np.float64)


def _context_counts(code: Code):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((_OFFSETS[-1], 2), np.float32)
        for batch in batches:
            for begin in range(0, batch.num_rows, 5_000):
                kind, key, cluster, n = _rows(batch, begin, 5_000)
                own = np.flatnonzero(kind != 1)
                if len(own):
                    data, early, whose = _spelled([key[k] if kind[k] == 0 else END for k in own])
                    weight = n[own][whose]
                    _counted(counts, data, cluster[own][whose], weight, np.where(early, 0, weight), code, range(INPUTS))
                own = np.flatnonzero(kind == 1)
                if len(own):
                    data, before, counted, whose = _paired(np.frombuffer(b"".join(key[k] for k in own), "<u4"))
                    _counted(counts, data, cluster[own][whose], np.where(counted, n[own][whose], 0), None, code, (ACROSS,), before)
        for block in range(-(-int(_OFFSETS[-1]) // BLOCK)):
            a, b = counts[block * BLOCK : (block + 1) * BLOCK].T
            if a.any() or b.any():
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([a.tobytes()]), pa.array([b.tobytes()])], names=["block", "zeros", "ones"])

    return run


def _summed(key, rows):
    import pandas as pd

    zeros, ones = (packed(np.sum([np.frombuffer(x, np.float32) for x in rows[c]], axis=0, dtype=np.float64)).astype(np.uint16) for c in ("zeros", "ones"))
    return pd.DataFrame({"block": [key[0]], "counts": [(zeros | ones << np.uint16(8)).tobytes()]})


# mixing ----------------------------------------------------------------------------------------------------------------


def predictions(data: np.ndarray, early: np.ndarray, cluster: np.ndarray, tables: Tables, before: np.ndarray | None = None, only: np.ndarray | None = None, left_out: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the bits of the symbols (those of ``only``): whose they are, +1 or -1, predictions, gates. ``left_out``: from counts
    without one occurrence of the bit itself."""
    hashes = contexts(data, cluster, before)
    length, node, bit = bits(data, tables.code, only)
    x, side = np.empty((INPUTS, len(node)), np.float32), bit.astype(np.uint32) << np.uint32(16)
    for k in range(INPUTS):
        counts = tables.counts[_OFFSETS[k] : _OFFSETS[k + 1]].take(slots(np.repeat(hashes[k], length), node, k))
        x[k] = LOGIT_LEFT_OUT.take(counts | side) if left_out else LOGIT[0].take(counts)
        if k == SO_FAR:
            gate = LEVEL[int(left_out)].take(counts)
    gate[np.repeat(early, length)] = GATES - 1
    return np.repeat(np.arange(len(data)), length), bit * 2 - 1, x, gate


def mixed_logits(x: np.ndarray, gate: np.ndarray, weights: np.ndarray, refine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Refined logits and their buckets."""
    dot = np.zeros(x.shape[1], np.float32)
    for k in range(INPUTS):
        dot += x[k] * weights[:, k].take(gate)
    bucket = np.clip(dot * np.float32(1.5) + np.float32(BUCKETS // 2), 0, BUCKETS - 1).astype(np.int32)
    return dot + refine.ravel().take(gate.astype(np.int32) * BUCKETS + bucket), bucket


def neutral() -> tuple[np.ndarray, np.ndarray]:
    return np.full((GATES, INPUTS), NEUTRAL, np.float32), np.zeros((GATES, BUCKETS), np.float32)


def learn(kind: np.ndarray, key: list[bytes], cluster: np.ndarray, n: np.ndarray, tables: Tables, weights: np.ndarray, refine: np.ndarray, rng: np.random.Generator) -> None:
    """Small steps over batches of the bits of words (kind 0) and neighbours (kind 1), each weighted by its count."""
    parts = []
    own = np.flatnonzero(kind == 0)
    if len(own):
        data, early, whose = _spelled([key[k] for k in own])
        owner, sign, x, gate = predictions(data, early, cluster[own][whose], tables, only=~early, left_out=True)
        parts.append((n[own][whose[owner]], sign, x, gate))
    own = np.flatnonzero(kind == 1)
    if len(own):
        data, before, counted, whose = _paired(np.frombuffer(b"".join(key[k] for k in own), "<u4"))
        owner, sign, x, gate = predictions(data, np.ones(len(data), bool), cluster[own][whose], tables, before, counted, left_out=True)
        parts.append((n[own][whose[owner]], sign, x, gate))
    if not parts:
        return
    amount, sign, x, gate = (np.concatenate(p, axis=-1) for p in zip(*parts))
    order = rng.permutation(len(sign))
    amount, sign, gate, x = np.sqrt(np.minimum(amount, 400)).astype(np.float32)[order], sign[order], gate[order].astype(np.int64), x.take(order, axis=1)
    gates = (gate[:, None] == np.arange(GATES)).astype(np.float32)
    for k in range(0, len(order), 4096):
        at = slice(k, k + 4096)
        own, g, xs = amount[at], gate[at], x[:, at]
        logit, bucket = mixed_logits(xs, g, weights, refine)
        error = sign[at] * own / (1 + np.exp(np.clip(logit * sign[at], -30, 30)))
        total = np.maximum(own @ gates[at], 50)
        weights += (RATE * ((xs * error) @ gates[at]) / total).T.astype(np.float32)
        flat = g * BUCKETS + bucket
        refine += (REFINE_RATE * np.bincount(flat, error, GATES * BUCKETS) / np.maximum(np.bincount(flat, own, GATES * BUCKETS), 50)).reshape(GATES, BUCKETS).astype(np.float32)


def learned_mixer(rows: DataFrame, tables: Tables, tasks: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and refinement, learned online in each of ``tasks`` parts of the rows (kind, key, cluster, n), in random order, and
    averaged by the amount that each part has seen."""
    keep = rows.sparkSession.sparkContext.broadcast(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (weights, refine), seen, rng = neutral(), 0, np.random.default_rng(11)
        for batch in batches:
            for begin in range(0, batch.num_rows, LEARN_ROWS):
                part = _rows(batch, begin, LEARN_ROWS)
                learn(*part, keep.value, weights, refine, rng)
                seen += len(part[1])
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([weights.ravel().tolist()], pa.list_(pa.float64())), pa.array([refine.ravel().tolist()], pa.list_(pa.float64()))], names=["seen", "weights", "refine"])

    ordered = rows.withColumn("h", F.xxhash64("key", F.lit(5))).repartition(tasks, "h").sortWithinPartitions("h", "key", "kind", "cluster").drop("h")
    got = sorted(map(tuple, ordered.mapInArrow(run, "seen bigint, weights array<double>, refine array<double>").collect()))
    keep.unpersist()
    if not got:
        return neutral()
    share = np.array([g[0] for g in got], float) / sum(g[0] for g in got)
    return tuple(np.tensordot(share, np.array([g[k] for g in got]), 1).reshape(GATES, -1).astype(np.float32) for k in (1, 2))


def spelt_sums(tables: Tables, weights: np.ndarray, refine: np.ndarray, data, early, cluster, owners, count, before=None, only=None) -> np.ndarray:
    """Natural log of the bits, summed by owner of the symbols."""
    owner, sign, x, gate = predictions(data, early, cluster, tables, before, only)
    logit, _ = mixed_logits(x, gate, weights, refine)
    chance = np.float32(0.9998) / (1 + np.exp(np.clip(-logit * sign, -30, 30))) + np.float32(0.0001)
    return np.bincount(owners[owner], np.log(chance), count)


def spelt(words: list[bytes], clusters: np.ndarray, tables: Tables, weights: np.ndarray, refine: np.ndarray) -> np.ndarray:
    """Natural log of the words' bits after their first two symbols."""
    out = [np.empty(0)]
    for k in range(0, len(words), 2_500):
        part = words[k : k + 2_500]
        data, early, whose = _spelled(part)
        out.append(spelt_sums(tables, weights, refine, data, early, clusters[k : k + 2_500][whose], whose, len(part), only=~early))
    return np.concatenate(out)


def fit(counts: Counts) -> Model:
    """The Huffman tree, the predictors' tables, the mixer and the frequent words, all from every training text. What reaches the driver is
    bounded by the number of slots and by HEAD."""
    table, spark = counts.table, counts.table.sparkSession
    clusters = len(counts.centres)
    letters = np.zeros(256)
    letters[END[0]] = counts.texts
    letters[32] = counts.tokens

    def spelled(batches):
        total = np.zeros(256)
        for batch in batches:
            n = batch.column("n").to_numpy().astype(float)
            for k in range(0, len(n), 50_000):
                words = batch.column("key").slice(k, 50_000).to_pylist()
                total += np.bincount(np.frombuffer(b"".join(words), np.uint8), np.repeat(n[k : k + 50_000], [len(w) for w in words]), 256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256), pa.int32()), pa.array(total, pa.float64())], names=["byte", "n"])

    for r in table.where("kind = 0").select("key", "n").mapInArrow(spelled, "byte int, n double").groupBy("byte").agg(F.sum("n").alias("n")).collect():
        letters[r["byte"]] += r["n"]
    code = huffman(letters)
    parts = table.where("kind < 3").select("kind", "key", F.posexplode("by_cluster").alias("cluster", "n")).where("n > 0")
    found = np.zeros(_OFFSETS[-1], np.uint16)
    learned = parts.coalesce(max(1, -(-counts.distinct // WORDS_A_TASK))).mapInArrow(_context_counts(code), "block int, zeros binary, ones binary")
    for r in learned.groupBy("block").applyInPandas(_summed, "block int, counts binary").toLocalIterator():
        found[r["block"] * BLOCK :][: len(r["counts"]) // 2] = np.frombuffer(r["counts"], np.uint16)
    tables = Tables(code, found)
    weights, refine = learned_mixer(parts.where("kind < 2"), tables, max(1, min(256, counts.distinct // LEARN_WORDS)))
    scale = np.log10(counts.tokens + 1 * (counts.distinct + 1))
    sizes = table.where("kind = 0").groupBy("n").agg(F.count("*").alias("words"))
    least, room, once = None, HEAD, 0
    for n, words in sorted(map(tuple, sizes.where("n > 1").orderBy(F.desc("n")).limit(HEAD).collect()), reverse=True):
        if words > room:
            break
        least, room = n, room - words
    single = sizes.where("n = 1").first()
    once = single["words"] if single else 0
    head, base, own, total, rest = np.empty(0, np.uint64), np.empty(0), np.empty((0, clusters)), np.empty(0), np.empty((0, clusters))
    if least is not None:
        got = table.where((F.col("kind") == 0) & (F.col("n") >= least)).select("key", "n", *(F.col("by_cluster")[k].alias(f"c{k}") for k in range(clusters)))
        got = got.mapInArrow(_frequent(spark.sparkContext.broadcast((tables, weights, refine)), clusters), "key binary, n bigint, own array<bigint>, rest array<float>").toArrow()
        head = hashes([[*got.column("key").to_pylist(), END]])
        base = np.log10(got.column("n").to_numpy() + 1.0) - scale
        own = got.column("own").combine_chunks().flatten().to_numpy().reshape(-1, clusters).astype(float)
        rest = got.column("rest").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, clusters)
        total = got.column("n").to_numpy().astype(float)
    sums = np.zeros(clusters)
    for r in parts.where("kind = 0").groupBy("cluster").agg(F.sum("n").alias("n")).collect():
        sums[r["cluster"]] = r["n"]
    everything, texts = float(max(1, counts.tokens)), counts.texts
    size = sums * (1 + texts / everything) + SMOOTH
    shares = np.vstack((shared(own, total, size, everything), np.log((sums + SMOOTH) * (texts + 1e-9) / everything / size))).astype(np.float32)
    rest = np.vstack((rest, spelt([END] * clusters, np.arange(clusters), tables, weights, refine))).astype(np.float32)
    whole = min(0.99, max(0.01, 1 - once / everything))
    return Model(uuid.uuid4().hex, tables, weights, refine, counts.centres, head, base, rest, shares, size, everything, float(np.log10(texts + 1) - scale), texts > 0, float(-scale), whole, least)


def _frequent(keep, clusters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bits of frequent words in the clusters where they occur."""
        for batch in batches:
            words = batch.column("key").to_pylist()
            own = np.column_stack([batch.column(f"c{k}").to_numpy() for k in range(clusters)])
            rest = np.full(own.shape, np.nan, np.float32)
            at, cluster = np.nonzero(own)
            rest[at, cluster] = spelt([words[k] for k in at], cluster, *keep.value)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n"), pa.array(list(own), pa.list_(pa.int64())), pa.array(list(rest), pa.list_(pa.float32()))], names=["key", "n", "own", "rest"])

    return run


class Places(dict):
    """Numbers of hashes, -1 for those that have none."""

    def __missing__(self, key: int) -> int:
        return -1


class Frequent:
    """Places of frequent words by hash: a table with open addressing that whole arrays look up at once."""

    def __init__(self, hashes: np.ndarray):
        self.bits = max(4, int(4 * len(hashes)).bit_length())
        self.keys, self.places = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
        left, slot = np.arange(len(hashes)), self._slot(hashes)
        while len(left):
            free = self.places[slot[left]] < 0
            _, first = np.unique(slot[left][free], return_index=True)
            won = left[free][first]
            self.keys[slot[won]], self.places[slot[won]] = hashes[won], won
            left = left[self.places[slot[left]] != left]
            slot[left] = slot[left] + 1 & (1 << self.bits) - 1

    def _slot(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each, -1 for those that aren't frequent."""
        slot = self._slot(hashes)
        out = np.where(self.keys[slot] == hashes, self.places[slot], -1).astype(np.int64)
        left = np.flatnonzero((out < 0) & (self.places[slot] >= 0))
        while len(left):
            slot[left] = slot[left] + 1 & (1 << self.bits) - 1
            met, own = self.places[slot[left]], self.keys[slot[left]] == hashes[left]
            out[left[own]] = met[own]
            left = left[~own & (met >= 0)]
        return out


class Speller:
    """What a worker keeps of a model's words: the frequent ones, and others it has met lately."""

    def __init__(self, model: Model):
        self.model, self.frequent = model, Frequent(model.head)
        self._forget()
        self.pair_keys, self.pair_values = np.full(1 << PAIR_SLOTS, 2**64 - 1, np.uint64), np.zeros(1 << PAIR_SLOTS)

    def _forget(self) -> None:
        self.others, self.rest = Places(), self.model.rest

    def words(self, cut: Cut, cluster: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words among those that are kept (the frequent ones and the end word stand first), and the logs of
        their bits after the first two symbols, for a cluster each."""
        if len(self.others) > KEPT:
            self._forget()
        at = self.frequent(cut.hashes)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            met, room = cut.hashes[missing].tolist(), len(self.model.head) + 1 + len(self.others)
            new = [h for h in dict.fromkeys(met) if self.others[h] < 0]
            self.others.update(zip(new, range(room, room + len(new))))
            room += len(new)
            if room > len(self.rest):
                self.rest = np.concatenate((self.rest, np.full((room + room // 8 - len(self.rest), self.rest.shape[1]), np.nan, np.float32)))
            at[missing] = list(map(self.others.__getitem__, met))
        unknown = np.flatnonzero(np.isnan(self.rest[at, cluster]))
        if len(unknown):
            pairs, first = np.unique(at[unknown] * self.rest.shape[1] + cluster[unknown], return_index=True)
            place, own = np.divmod(pairs, self.rest.shape[1])
            if self.rest is self.model.rest:  # never written to: other models of the process may share it
                self.rest = self.rest.copy()
            self.rest[place, own] = spelt([cut.word(k) for k in unknown[first]], own, self.model.tables, self.model.weights, self.model.refine)
        return at, self.rest[at, cluster].astype(float)

    def starts(self, keys: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        """Logs of the bits of words' first two symbols."""
        full = keys.astype(np.uint64) | cluster.astype(np.uint64) << np.uint64(32)
        slot = C.mixed(full) >> np.uint64(64 - PAIR_SLOTS)
        out, missing = self.pair_values[slot], np.flatnonzero(self.pair_keys[slot] != full)
        if len(missing):
            new, at = np.unique(full[missing], return_inverse=True)
            data, before, counted, whose = _paired((new & np.uint64(0xFFFFFFFF)).astype(np.uint32))
            own = (new >> np.uint64(32)).astype(np.int64)[whose]
            values = spelt_sums(self.model.tables, self.model.weights, self.model.refine, data, np.ones(len(data), bool), own, whose, len(new), before, counted)
            out[missing] = values[at]
            place = C.mixed(new) >> np.uint64(64 - PAIR_SLOTS)
            self.pair_keys[place], self.pair_values[place] = new, values  # of those that share a slot one is kept
        return out


_SPELLERS: dict[str, Speller] = {}


def _speller(model: Model) -> Speller:
    if model.name not in _SPELLERS:
        _SPELLERS.clear()
        _SPELLERS[model.name] = Speller(model)
    return _SPELLERS[model.name]


def gated(logs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Log of each text's probability, from the logs of its phrases (phrase x expert, -inf where an expert rules one out). The
    gate learns after every phrase, anew in each text; all texts run in lockstep."""
    total = np.zeros(len(lengths))
    if not len(logs):
        return total
    order = np.argsort(-lengths, kind="stable")
    start = (np.cumsum(lengths) - lengths)[order]
    state = np.tile(np.log(EXPERTS), (len(lengths), 1))
    active = np.searchsorted(-lengths[order], -np.arange(lengths.max()), side="left")
    for t, n in enumerate(active):
        weight = np.exp(state[:n] - state[:n].max(axis=1, keepdims=True))
        weight /= weight.sum(axis=1, keepdims=True)
        own = logs[start[:n] + t] + np.log(weight)
        top = own.max(axis=1, keepdims=True)
        both = top + np.log(np.exp(own - top).sum(axis=1, keepdims=True))
        total[order[:n]] += both[:, 0]
        state[:n] = np.clip(np.log(weight) + GATE_RATE * (np.exp(own - both) - weight), -6, 6)
    return total


DEALT = "row bigint, doc_id bigint, held_out boolean, trained boolean, cluster int, n_tokens bigint, symbols bigint, known bigint, base double, mixture array<double>, bits array<double>, phrases array<struct<key:binary,own:int,own_ahead:int>>, rare array<struct<word:binary,phrase:int,spelt:double>>"


def _dealt(keep):
    """Of each text what needs no join: sums over its phrases with the frequent words' shares, and its other words, which
    count as not met until the join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = keep.value
        speller, row = _speller(model), TaskContext.get().partitionId() << 36
        frequent, away = len(model.head), np.log(1 - model.whole)
        base = np.concatenate((model.base, [model.end]))
        phrase_type = pa.struct([("key", pa.binary()), ("own", pa.int32()), ("own_ahead", pa.int32())])
        rare_type = pa.struct([("word", pa.binary()), ("phrase", pa.int32()), ("spelt", pa.float64())])

        def lists(values, lengths, kind):
            return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32()), values if isinstance(values, pa.Array) else pa.array(values, kind))

        def scored(part, texts):
            nonlocal row
            cut, cluster = Cut(texts), nearest(byte_pairs(texts), model.centres)
            lengths = cut.lengths
            owner = np.repeat(np.arange(len(texts)), lengths)
            of = cluster[owner]
            own, spelt_ = speller.words(cut, cluster[cut.text])
            at, bits_ = cut.spread(own, frequent, np.int64), cut.spread(spelt_, speller.rest[frequent, cluster], float)
            bits_ += speller.starts(cut.neighbours(), of)
            mixture, met = bits_ + away, np.flatnonzero(at <= frequent)
            mixture[met] = np.logaddexp(mixture[met], np.log(model.whole) + model.shares[at[met], of[met]])
            keys, stops, many = phrases(cut.hashes, cut.own)
            ends = stops + np.repeat(np.cumsum(lengths) - lengths, many)
            phrase = np.repeat(np.arange(len(keys)), np.diff(ends, prepend=0))
            first = np.cumsum(many) - many
            others = np.flatnonzero(own > frequent)
            rare = cut.place[others]
            known = np.bincount(owner[met], minlength=len(texts)) - (0 if model.end_known else 1)
            sums = np.bincount(owner, np.append(base, model.unknown)[np.minimum(at, frequent + 1)], len(texts))
            counted = []
            for column in (0, 1):  # how often this text has the same four words ahead, and the same phrase
                which = C.mixed(keys[:, column] + C.mixed(np.repeat(np.arange(1, len(texts) + 1, dtype=np.uint64), many)))
                _, back, n = np.unique(which, return_inverse=True, return_counts=True)
                counted.append(n[back])
            joined = pa.StructArray.from_arrays([_padded(keys.astype(">u8")), pa.array(counted[1], pa.int32()), pa.array(counted[0], pa.int32())], fields=list(phrase_type))
            others = pa.StructArray.from_arrays([pa.array([cut.word(k) for k in others], pa.binary()), pa.array((phrase - first[owner])[rare], pa.int32()), pa.array(bits_[rare], pa.float64())], fields=list(rare_type))
            columns = [
                pa.array(range(row, row + len(texts)), pa.int64()), *(part.column(c) for c in ("doc_id", "held_out", "trained")), pa.array(cluster, pa.int32()),
                pa.array(lengths, pa.int64()), pa.array(np.bincount(cut.text, cut.ends - cut.starts, len(texts)).astype(np.int64) + 1 + lengths, pa.int64()), pa.array(known, pa.int64()), pa.array(sums, pa.float64()),
                lists(np.bincount(phrase, mixture, len(keys)), many, pa.float64()), lists(np.bincount(phrase, bits_, len(keys)), many, pa.float64()), lists(joined, many, phrase_type), lists(others, np.bincount(owner[rare], minlength=len(texts)), rare_type),
            ]
            row += len(texts)
            return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in DEALT.replace("struct<key:binary,own:int,own_ahead:int>", "s").replace("struct<word:binary,phrase:int,spelt:double>", "s").split(", ")])

        for batch in batches:
            texts = C.texts(batch, "text")
            begin, size = 0, 0
            for k, text in enumerate(texts):
                size += len(text or "")
                if size >= CHUNK or k + 1 == len(texts):
                    yield scored(batch.slice(begin, k + 1 - begin), texts[begin : k + 1])
                    begin, size = k + 1, 0

    return run


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The gate over the phrases of each text, once the joins have told what its words and phrases were met with."""
    _SPELLERS.clear()
    for batch in batches:
        if not batch.num_rows:
            continue
        mixture, bits_ = (batch.column(c) for c in ("mixture", "bits"))
        lengths = np.diff(mixture.offsets.to_numpy())
        logs = np.column_stack((mixture.flatten().to_numpy(), bits_.flatten().to_numpy(), np.full(int(lengths.sum()), -np.inf)))
        first = np.cumsum(lengths) - lengths
        for name, column, put in (("more", 0, np.add.at), ("told", 2, lambda x, at, value: x.__setitem__(at, value))):
            found = batch.column(name)
            each = pc.fill_null(pc.list_value_length(found), 0).to_numpy(zero_copy_only=False)
            place, value = (found.flatten().field(k).to_numpy() for k in (0, 1))
            put(logs[:, column], np.repeat(first, each) + place, value)
        total = (gated(logs, lengths) - np.log(CLUSTERS)) / np.log(10)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "held_out", "n_tokens", "n_known", "base_score")), pa.array(total, pa.float64()), batch.column("symbols")], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "symbols"])


def score(documents: DataFrame, held_out: Column, counts: Counts, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of the mixed
    model's probability) and bits_per_byte.

    Null texts count as empty: only the end token; rows that repeat are scored each on its own; rows without
    an id aren't trained on; with nothing trained the base is uniform over the one unseen token."""
    spark = documents.sparkSession
    source = C.small_batches(documents).select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(~held_out, F.lit(False)).alias("trained"), F.col(text_col).alias("text"))
    rows = C.stored(source.mapInArrow(_dealt(spark.sparkContext.broadcast(model)), DEALT))

    words = counts.table.where("kind = 0" if model.least is None else f"kind = 0 and n < {model.least}")  # their counts are small
    words = words.select(F.col("key").alias("word"), F.col("n").cast("int").alias("n"), F.col("by_cluster").cast("array<int>").alias("by_cluster")) if model.least is not None else words.select(F.col("key").alias("word"), "n", "by_cluster")
    rare = rows.select("row", "cluster", F.explode("rare").alias("r")).select("row", "cluster", "r.word", "r.phrase", "r.spelt").join(words, "word")
    own = F.get("by_cluster", F.col("cluster"))
    size = F.element_at(F.array(*(F.lit(float(s)) for s in model.sizes)), F.col("cluster") + 1)
    share = (own + F.lit(SMOOTH / model.everything) * F.col("n")) / size
    odds = F.lit(model.whole / (1 - model.whole))
    gain = F.log1p(odds * share * F.exp(-F.col("spelt")))  # what the whole word's share adds to the bits alone
    more = rare.select("row", "phrase", gain.alias("gain"), F.log10(F.col("n") + 1).alias("base_gain"))
    more = more.groupBy("row").agg(F.collect_list(F.struct("phrase", "gain")).alias("more"), F.count("*").alias("also_known"), F.sum("base_gain").alias("base_gain"))

    met = counts.table.where("kind = 3").select("key", F.substring("key", 1, 8).alias("ahead"), "n")
    ahead = C.stored(met.groupBy("ahead").agg(F.sum("n").alias("of"), F.count("*").alias("times")))
    met = C.left_join_with_hot(met, ahead, ["ahead"], "times", PHRASES_BROADCAST).select("key", F.col("n").alias("times"), F.col("n").alias("met"), "of")
    asked = rows.select("row", "trained", F.posexplode("phrases").alias("phrase", "p")).select("row", "phrase", "p.key", F.when(F.col("trained"), F.col("p.own")).otherwise(0).alias("own"), F.when(F.col("trained"), F.col("p.own_ahead")).otherwise(0).alias("own_ahead"))
    told = C.left_join_with_hot(asked, C.stored(met), ["key"], "times", PHRASES_BROADCAST).where("met > own")
    told = told.select("row", "phrase", F.log((F.col("met") - F.col("own")) / (F.col("of") - F.col("own_ahead") + 1)).alias("log"))
    told = told.groupBy("row").agg(F.collect_list(F.struct("phrase", "log")).alias("told"))

    out = rows.drop("phrases", "rare", "trained", "cluster").join(more, "row", "left").join(told, "row", "left")
    out = out.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("also_known", F.lit(0))).alias("n_known"), (F.col("base") + F.coalesce("base_gain", F.lit(0.0))).alias("base_score"), "symbols", "mixture", "bits", "more", "told")
    out = out.mapInArrow(_finished, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double, symbols bigint")
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(counts.tokens).cast("bigint").alias("train_tokens"),
        "base_score",
        "score",
        (-F.col("score") / F.lit(float(np.log10(2))) / F.col("symbols")).alias("bits_per_byte"),
    )
