"""Vector bin packing of tokenised examples into fixed-length training sequences.

Each example is a vector (tokens, segments, loss-bearing tokens); a sequence has a limit on each.
An open sequence takes the waiting example with the largest dot product between its vector and the
room that is left, both in units of the limits, as long as one fits; the rest is filled by cutting
the next best one. A sequence that still isn't full at the end of a partition is dealt out as
sequences whose lengths are powers of two, which need no padding.

Packing is local to a partition of the input: nothing is shuffled, at most ``POOL`` example ends
wait at once, and a task that runs again after a lost executor gives the same sequences.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

POOL = 768
END = np.array([1], "<u4").tobytes()
SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, loss_tokens bigint, sequence_id bigint, offset bigint"
_CACHE_WORDS = 500_000


class Limits(NamedTuple):
    tokens: int = 2048
    segments: int = 512
    loss_tokens: int = 2048


class Tokenizer:
    """Ids as little-endian unsigned 32-bit bytes, exactly as the vocabulary's own tokenizer gives them.

    No pre-token of such a vocabulary crosses ASCII white space, so ids are kept by word. A word of
    Latin letters and closing marks is two pre-tokens that go to the merges directly; any other goes
    through the whole tokenizer."""

    PLAIN = re.compile(r"([a-zß-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")

    def __init__(self, path: str | None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer as Base

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        self.base = Base.from_file(path)
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = [b for b in range(256) if b not in shown]
        self.letters = dict(zip(shown, shown)) | {b: 256 + k for k, b in enumerate(hidden)}
        self.direct = all(self._merged(w) == self._whole(w) for w in ("the", "straße", "ñandú", "%%%"))

    def _whole(self, word: str) -> bytes:
        return np.array(self.base.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _merged(self, part: str) -> bytes:
        if (found := self.parts.get(part)) is None:
            shown = part.encode().decode("latin-1").translate(self.letters)
            found = self.parts[part] = b"".join(t.id.to_bytes(4, "little") for t in self.base.model.tokenize(shown))
        return found

    def _ids(self, word: str) -> bytes:
        if self.direct and (m := self.PLAIN.fullmatch(word.lower())):
            return self._merged(m[1]) + (self._merged(m[2]) if m[2] else b"")
        return self._whole(word)

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        if len(self.known) > _CACHE_WORDS:
            self.known.clear()
        if len(self.parts) > _CACHE_WORDS:
            self.parts.clear()
        for w in {w for words in split for w in words} - self.known.keys():
            self.known[w] = self._ids(w)
        return [b"".join(map(self.known.__getitem__, words)) for words in split]


_LOADED: dict[str | None, Tokenizer] = {}


def tokenizer(path: str | None = None) -> Tokenizer:
    if path not in _LOADED:
        _LOADED[path] = Tokenizer(path)
    return _LOADED[path]


class Packer:
    """Packs examples one after another; ``sequences`` yields lists of (example, start, length, loss)."""

    def __init__(self, limits: Limits):
        self.limits = limits
        self.scale = np.array(limits, float)
        self.items: list[tuple[int, int, int]] = []  # example, start, stop
        self.size = np.empty((0, 3))
        self.loss: dict[int, np.ndarray | None] = {}
        self.left: dict[int, int] = {}

    def _vector(self, item: tuple[int, int, int]) -> tuple[float, float, float]:
        example, start, stop = item
        prefix = self.loss[example]
        return stop - start, 1, stop - start if prefix is None else prefix[stop] - prefix[start]

    def _fitting(self, item: tuple[int, int, int], room: np.ndarray) -> int:
        """The longest beginning of an item within the room."""
        example, start, stop = item
        stop = min(stop, start + int(room[0]))
        prefix = self.loss[example]
        if prefix is None:
            return min(stop - start, int(room[2]))
        return max(0, min(stop, int(np.searchsorted(prefix, prefix[start] + room[2], side="right")) - 1) - start)

    def add(self, example: int, tokens: int, loss: np.ndarray | None) -> Iterator[list[tuple[int, int, int, int]]]:
        """``loss``: for each token whether it bears loss; None: all do. Whole sequences leave at once."""
        self.loss[example] = None if loss is None else np.concatenate(([0], np.cumsum(loss)))
        start = 0
        while tokens - start >= self.limits.tokens:
            n = self._fitting((example, start, tokens), self.scale)
            if n < self.limits.tokens:
                break
            yield [(example, start, n, int(self._vector((example, start, start + n))[2]))]
            start += n
        while start < tokens:
            n = self._fitting((example, start, tokens), self.scale) or 1
            self.items.append((example, start, start + n))
            self.size = np.vstack((self.size, self._vector(self.items[-1])))
            self.left[example] = self.left.get(example, 0) + 1
            start += n
        while len(self.items) >= POOL:
            yield self._sequence()

    def _sequence(self) -> list[tuple[int, int, int, int]]:
        room, out = self.scale.copy(), []
        while self.items and room[0] >= 1 and room[1] >= 1:
            gain = self.size @ (room / self.scale**2)
            fits = (self.size <= room).all(axis=1)
            if fits.any():
                k = int(np.argmax(np.where(fits, gain, -1)))
                n = self.items[k][2] - self.items[k][1]
            else:
                k = int(np.argmax(gain))
                n = self._fitting(self.items[k], room)
                if not n:
                    break
            example, start, stop = self.items[k]
            taken = np.array(self._vector((example, start, start + n)))
            out.append((example, start, n, int(taken[2])))
            room -= taken
            if start + n == stop:
                self.items[k] = self.items[-1]
                self.size[k] = self.size[-1]
                self.items.pop()
                self.size = self.size[:-1]
                self.left[example] -= 1
            else:
                self.items[k] = (example, start + n, stop)
                self.size[k] = self._vector(self.items[k])
        return out

    def finish(self) -> Iterator[list[tuple[int, int, int, int]]]:
        while self.items:
            yield from self._powers(self._sequence())

    def _powers(self, pieces: list[tuple[int, int, int, int]]) -> Iterator[list[tuple[int, int, int, int]]]:
        total = sum(n for _, _, n, _ in pieces)
        at, pieces = 0, [p[:3] for p in pieces]
        while total:
            want = total if total == self.limits.tokens else 1 << (total.bit_length() - 1)
            total, out = total - want, []
            while want:
                example, start, n = pieces[at]
                take = min(n, want)
                out.append((example, start, take, int(self._vector((example, start, start + take))[2])))
                want -= take
                if take == n:
                    at += 1
                else:
                    pieces[at] = (example, start + take, n - take)
            yield out


def packed(examples: Iterable[tuple[int, bytes, np.ndarray | None]], limits: Limits, first: int, with_ids: bool) -> Iterator[tuple]:
    """Rows of SCHEMA, and the ids if asked for. ``examples``: (id, ids, loss flags)."""
    packer, ids, number = Packer(limits), {}, first

    def rows(sequence):
        nonlocal number
        offset = 0
        for k, start, n, loss in sequence:
            doc, data = ids[k]
            piece = data[4 * start : 4 * (start + n)]
            yield (doc, start, n, zlib.crc32(piece), len(data) // 4, loss, number, offset) + ((np.frombuffer(piece, "<u4").astype(np.int32),) if with_ids else ())
            offset += n
        number += 1
        for k, *_ in sequence:
            if current is not None and k != current and not packer.left.get(k, 0):
                ids.pop(k, None), packer.loss.pop(k, None), packer.left.pop(k, None)

    current = None
    for current, (doc, data, loss) in enumerate(examples):
        ids[current] = (doc, data)
        for sequence in packer.add(current, len(data) // 4, loss):
            yield from rows(sequence)
        if not packer.left.get(current, 0):
            ids.pop(current, None), packer.loss.pop(current, None)
    current = None
    for sequence in packer.finish():
        yield from rows(sequence)


def _written(rows: Iterator[tuple], with_ids: bool) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = [pa.int64()] * len(names) + [pa.list_(pa.int32())] * with_ids
    names += ["ids"] * with_ids
    waiting: list[tuple] = []

    def batch():
        columns = list(zip(*waiting)) if waiting else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)

    for row in rows:
        waiting.append(row)
        if len(waiting) >= (1_000 if with_ids else 20_000):
            yield batch()
            waiting.clear()
    if waiting:
        yield batch()


def pack_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits(), vocabulary: str | None = None, with_ids: bool = True) -> DataFrame:
    """Pack every row's whole text, tokens closed by id 1; every token bears loss.

    Null text counts as empty (one piece holding the closing id); repeated rows are packed each on
    its own; other columns are ignored; an empty table gives no rows. ``vocabulary``: a tokenizers
    file (default: the public word vocabulary)."""
    return pack_examples(df.select(F.col(id_col).alias("doc_id"), F.array(F.struct(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.lit(True).alias("loss"))).alias("segments")), limits=limits, vocabulary=vocabulary, with_ids=with_ids)


def pack_examples(df: DataFrame, id_col: str = "doc_id", segments_col: str = "segments", limits: Limits = Limits(), vocabulary: str | None = None, with_ids: bool = True) -> DataFrame:
    """Pack instruction examples: ``segments`` is array<struct<text, loss>>; only tokens of segments
    with loss (and the closing id after such a segment) bear it. Null arrays and texts are empty."""
    if min(limits) < 1:
        raise ValueError("limits must be positive")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(vocabulary)

        def examples():
            for batch in batches:
                for begin in range(0, batch.num_rows, 512):
                    part = batch.slice(begin, 512)
                    docs = part.column(0).to_pylist()
                    rows = [[(s["text"] or "", bool(s["loss"])) for s in x or [] if s] for x in part.column(1).to_pylist()]
                    encoded = iter(own.encode([t for x in rows for t, _ in x]))
                    for doc, x in zip(docs, rows):
                        pieces = [(next(encoded), loss) for _, loss in x]
                        data = b"".join(p for p, _ in pieces) + END
                        flags = None
                        if not all(loss for _, loss in pieces):
                            flags = np.concatenate([np.full(len(p) // 4, loss) for p, loss in pieces] + [[pieces[-1][1]]]) if pieces else np.zeros(1, bool)
                        yield doc, data, flags

        first = TaskContext.get().partitionId() << 36
        yield from _written(packed(examples(), limits, first, with_ids), with_ids)

    return C.small_batches(df).select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(segments_col).alias("segments")).mapInArrow(run, SCHEMA + ", ids array<int>" * with_ids)


def conversation_examples(df: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) to instruction examples; assistant turns bear loss."""
    turn = F.struct(F.col("turn"), F.col("text"), (F.col("role") == "assistant").alias("loss"))
    return df.groupBy(F.col("conv_id").alias("doc_id")).agg(F.transform(F.array_sort(F.collect_list(turn)), lambda x: F.struct(x["text"].alias("text"), x["loss"].alias("loss"))).alias("segments"))
