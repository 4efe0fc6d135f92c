"""Near-duplicate documents: MinHash bands, signature check, exact confirmation and connected components.

1. Sketch. A document's distinct word shingles are hashed to 64 bits; ``BANDS * ROWS`` universal
   hashes (odd multiply, add, upper 32 bits) give the minima. Documents with the same shingle set
   form a class, for which the smallest id stands.
2. Candidates. Classes that share a band meet at pivots: each band bucket has its own random pivot,
   so a bucket of any size gives a number of pairs proportional to its members. A class first
   confirms its most frequent pivot, then the others that are still in another component.
3. The rest, exactly. Buckets that still hold several components compare every pair of members
   across components by signature: small ones in the join; in large ones the members outside the bucket's
   largest component meet all members, in blocks dealt over tasks.
4. Confirmation reads both full shingle sets. Links become components by alternating large-star and
   small-star rounds, each written to the shared folder.

No step brings all rows of a frequent bucket, pivot, component or digest into one task: what such a key is joined
to travels to its rows (``common.left_join_with_hot``), and the sets of a pivot with many pairs are salted.

With 25 bands of 5 rows a pair at similarity 0.85 shares no band with probability 4e-7, one at 0.80 with 5e-5; a pair
at the threshold has signatures that agree on less than the slack allows with probability 5e-6 or less. Both concern
a single link: members of a group have many.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

BANDS, ROWS = 25, 5
SMALL_BUCKET = 24
#: At most so many rows are broadcast, those of the most frequent keys.
BROADCAST_ROWS = 200_000
#: Pairs that meet one copy of a document's shingle set.
SHARE = 500
BLOCK = 512
#: A pair whose signatures agree on less than threshold - SLACK isn't confirmed: over four standard errors.
SLACK = 0.16
_RNG = np.random.default_rng(20_240_229)
_A = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
_BAND_SALT = _RNG.integers(0, 2**63, BANDS, dtype=np.uint64)
SKETCH = "doc_id bigint, n_shingles bigint, digest binary, keys array<bigint>, bands binary, signature binary"


def minima(shingles: np.ndarray) -> np.ndarray:
    """The minimum of each universal hash over the shingles."""
    best = np.full(len(_A), np.uint64(2**64 - 1))
    for k in range(0, len(shingles), 512):
        values = shingles[k : k + 512, None] * _A
        values += _B
        np.minimum(best, values.min(axis=0), out=best)
    return (best >> np.uint64(32)).astype(np.uint32)


def band_keys(signature: np.ndarray) -> np.ndarray:
    rows = signature.reshape(BANDS, ROWS).astype(np.uint64)
    key = _BAND_SALT.copy()
    for k in range(ROWS):
        key = C.mixed(key ^ rows[:, k])
    return key.view(np.int64)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, 2000):
            part = batch.slice(begin, 2000)
            counts, digests, keys, bands, signatures = [], [], [], [], []
            for text in C.texts(part, "text"):
                shingles = C.shingle_set(C.word_hashes((text or "").encode()))
                counts.append(len(shingles))
                if not len(shingles):
                    digests.append(None), keys.append(None), bands.append(None), signatures.append(None)
                    continue
                signature = minima(shingles)
                digests.append(xxhash.xxh3_128_digest(shingles.tobytes()))
                keys.append(band_keys(signature))
                bands.append(keys[-1].tobytes())
                signatures.append(signature.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(bands, pa.binary()), pa.array(signatures, pa.binary())],
                names=["doc_id", "n_shingles", "digest", "keys", "bands", "signature"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, 1000):
            part = batch.slice(begin, 1000)
            sets = [C.shingle_set(C.word_hashes((t or "").encode())).tobytes() for t in C.texts(part, "text")]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sets, pa.binary())], names=["rep", "shingles"])


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("set_a"), batch.column("set_b")):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                small = min(len(x), len(y))
                if 100 * small < percent * max(len(x), len(y)):
                    keep.append(False)
                    continue
                both = np.concatenate((x, y))
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(both) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _agreeing(percent: int):
    """Pairs whose signatures agree well enough to be worth confirming."""
    least = (percent / 100 - SLACK) * BANDS * ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
                yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= least))

    return run


def _linked(percent: int):
    """Links between members outside a bucket's largest component and all its members that are in different
    components. Members that a link has joined aren't compared again, and two that share several buckets meet in the one
    with the smallest key."""
    least = (percent / 100 - SLACK) * BANDS * ROWS

    def run(key, left, right):
        import pandas as pd

        out: list[tuple[int, int]] = []
        if len(left) and len(right):
            (x, kx), (y, ky) = (tuple(np.frombuffer(b"".join(df[c]), t).reshape(len(df), -1) for c, t in ((f"signature{n}", np.uint8), (f"bands{n}", np.int64))) for df, n in ((left, ""), (right, "2")))
            ida, idb = left["rep"].to_numpy(), right["rep2"].to_numpy()
            sa, sb = ([np.frombuffer(v, np.uint64) for v in df] for df in (left["shingles"], right["shingles2"]))
            names, of = np.unique(np.concatenate((left["component"], right["component2"])), return_inverse=True)
            root = np.arange(len(names))
            ca, cb = of[: len(ida)], of[len(ida) :]
            largest = right["largest2"].to_numpy()  # those stand on this side only, the others on both
            for k in range(len(x)):
                near = np.flatnonzero(((x[k] == y).sum(axis=1) >= least) & (root[cb] != root[ca[k]]) & ((idb > ida[k]) | largest))
                if not len(near):
                    continue
                first = np.where(kx[k] == ky[near], kx[k], np.iinfo(np.int64).max).min(axis=1) == key[0]
                for o in near[first]:
                    if root[cb[o]] == root[ca[k]]:
                        continue
                    small, big = sorted((len(sa[k]), len(sb[o])))
                    if 100 * small < percent * big:
                        continue
                    both = np.concatenate((sa[k], sb[o]))
                    both.sort()
                    shared = int((both[1:] == both[:-1]).sum())
                    if 100 * shared >= percent * (len(both) - shared):
                        out.append((min(ida[k], idb[o]), max(ida[k], idb[o])))
                        root[root == root[cb[o]]] = root[ca[k]]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the links (a, b): the smallest node that is reachable.

    Alternating large-star and small-star rounds over DataFrames until the links no longer change."""
    edges = C.stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark, rows = None, edges.count()
    while True:
        for star in ("large", "small"):
            around = edges if star == "small" else edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = around.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("degree"))
            if rows > BROADCAST_ROWS:
                least = C.stored(least)
                joined = C.left_join_with_hot(around, least, ["u"], "degree", BROADCAST_ROWS)
            else:  # at most two nodes a link
                joined = around.join(F.broadcast(least.drop("degree")), "u")
            if star == "large":
                edges = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
            else:
                edges = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v")))
            edges = edges.distinct()
        edges = C.stored(edges)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.coalesce(F.sum((F.col("u") <= F.col("v")).cast("int")), F.lit(0))).first()
        if now == mark or not now[0]:
            break
        mark, rows = now, now[0]
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())


class _Links:
    """Confirmed links so far and the components they make."""

    def __init__(self, texts: DataFrame, reps: DataFrame, percent: int):
        self.texts, self.reps, self.percent = texts, reps, percent
        self.sets: DataFrame | None = None
        self.edges: DataFrame | None = None
        self.of: DataFrame | None = None

    def labelled(self, df: DataFrame, column: str, name: str) -> DataFrame:
        if self.of is None:
            return df.withColumn(name, F.col(column))
        return df.join(self.of.select(F.col("node").alias(column), F.col("component").alias(name)), column, "left").withColumn(name, F.coalesce(name, column))

    def across(self, pairs: DataFrame) -> DataFrame:
        return self.labelled(self.labelled(pairs, "a", "ca"), "b", "cb").where("ca <> cb").select("a", "b")

    def with_sets(self, rows: DataFrame, pairs: DataFrame, column: str) -> DataFrame:
        """``rows``, the ``pairs`` with what they have been joined to, with the shingle set of the document in ``column``. The set
        of one with more than SHARE pairs is copied, and its pairs are dealt out to the copies."""
        sets = self.sets.select(F.col("rep").alias(column), F.col("shingles").alias(f"set_{column}"))
        busy = pairs.groupBy(column).agg(F.count("*").alias("times")).where(F.col("times") > SHARE)
        if busy.isEmpty():
            return rows.join(sets, column)
        copies = C.stored(busy.withColumn("parts", F.ceil(F.col("times") / F.lit(SHARE)).cast("int")))
        parts = F.coalesce("parts", F.lit(1))
        dealt = C.left_join_with_hot(rows, copies, [column], "times", BROADCAST_ROWS).withColumn("salt", F.pmod(F.xxhash64("a", "b"), parts).cast("int")).drop("parts")
        sets = sets.join(copies.drop("times"), column, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
        return dealt.join(sets, [column, "salt"]).drop("salt")

    def confirm(self, pairs: DataFrame) -> None:
        """pairs: (a, b), each once."""
        pairs = C.stored(pairs)
        both = self.with_sets(self.with_sets(pairs, pairs, "a"), pairs, "b").select("a", "b", "set_a", "set_b")
        found = C.stored(both.mapInArrow(_confirmed(self.percent), "a bigint, b bigint"))
        self.add(found)

    def add(self, found: DataFrame) -> None:
        if found.isEmpty():
            return
        self.edges = found if self.edges is None else self.edges.union(found)
        self.of = C.stored(components(self.edges))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``df``.

    Documents are linked when 100 * shared >= percent * united shingles. Null and empty texts have no
    shingles and no links; texts of under five words are one shingle; equal texts always share a
    component; rows that repeat an id share that id's component; rows without an id get no component
    but their own null; an empty table gives no rows; other columns are ignored."""
    source = C.small_batches(df).select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    sketch = C.stored(source.mapInArrow(_sketches, SKETCH))
    named = sketch.where("doc_id is not null and digest is not null")
    classes = C.stored(named.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    member = C.stored(C.left_join_with_hot(named.select("doc_id", "digest"), classes, ["digest"], "n", BROADCAST_ROWS).select("doc_id", "rep").distinct())
    reps = named.join(classes.select(F.col("rep").alias("doc_id"), "digest"), ["doc_id", "digest"], "left_semi").dropDuplicates(["doc_id", "digest"])
    keyed = reps.select(F.col("doc_id").alias("rep"), F.explode("keys").alias("key")).distinct()
    order = F.struct(F.xxhash64("rep", "key").alias("h"), F.col("rep"))
    buckets = C.stored(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min(order)["rep"].alias("pivot")).where("n > 1"))
    shared = C.stored(C.left_join_with_hot(keyed, buckets.withColumn("size", F.col("n")), ["key"], "n", BROADCAST_ROWS).where("pivot is not null"))
    pivots = C.stored(shared.where("rep <> pivot").groupBy(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b"), "rep").agg(F.count("*").alias("times")))
    links = _Links(source, reps, percent)
    wanted = shared.select(F.col("rep").alias("doc_id")).distinct()
    one = source.join(wanted, "doc_id", "left_semi").mapInArrow(_sets, "rep bigint, shingles binary")
    links.sets = C.stored(one)
    best = pivots.groupBy("rep").agg(F.max(F.struct("times", -F.col("a"), -F.col("b"), "a", "b")).alias("x"))
    links.confirm(best.select("x.a", "x.b").distinct())
    links.confirm(links.across(pivots.select("a", "b").distinct()))

    grouped = C.stored(links.labelled(shared.select("key", "rep"), "rep", "component"))
    parts = grouped.groupBy("key", "component").agg(F.count("*").alias("c")).groupBy("key")
    mixed = C.stored(parts.agg(F.sum("c").alias("n"), F.max("c").alias("most"), F.max(F.struct("c", "component"))["component"].alias("largest"), F.count("*").alias("parts")).where("parts > 1").drop("parts"))
    traits = reps.groupBy(F.col("doc_id").alias("rep")).agg(F.min(F.struct("digest", "signature", "bands")).alias("t")).select("rep", "t.signature", "t.bands")
    open_ = C.left_join_with_hot(grouped, mixed.withColumn("size", F.col("n")), ["key"], "n", BROADCAST_ROWS).where("largest is not null").join(traits, "rep")
    small = open_.where(F.col("size") <= SMALL_BUCKET).select("key", F.col("rep").alias("a"), F.col("component").alias("ca"), F.col("signature").alias("sa"))
    other = small.select("key", F.col("a").alias("b"), F.col("ca").alias("cb"), F.col("sa").alias("sb"))
    pairs = small.join(other, "key").where("a < b and ca <> cb").select("a", "b", "sa", "sb").mapInArrow(_agreeing(percent), "a bigint, b bigint").distinct()
    links.confirm(pairs.join(pivots.select("a", "b"), ["a", "b"], "left_anti"))

    blocks = lambda n: F.ceil(n / F.lit(BLOCK))
    large = open_.where(F.col("size") > SMALL_BUCKET).join(links.sets, "rep").withColumn("in_largest", F.col("component") == F.col("largest"))
    large = large.withColumn("i", F.pmod(F.xxhash64("rep"), blocks(F.col("size") - F.col("most")))).withColumn("j", F.pmod(F.xxhash64("rep"), blocks(F.col("size"))))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), blocks(n) - 1))
    held = ("rep", "component", "signature", "bands", "shingles")
    left = large.where("not in_largest").select("key", "i", every(F.col("size")).alias("j"), *held)
    right = large.select(F.col("key").alias("key2"), every(F.col("size") - F.col("most")).alias("i2"), F.col("j").alias("j2"), F.col("in_largest").alias("largest2"), *(F.col(c).alias(f"{c}2") for c in held))
    wide = left.groupBy("key", "i", "j").cogroup(right.groupBy("key2", "i2", "j2")).applyInPandas(_linked(percent), "a bigint, b bigint")
    links.add(C.stored(wide.distinct()))

    # rows that repeat an id stand in several classes: those are linked through the id
    repeated = member.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    twins = member.join(repeated, "doc_id", "left_semi").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).where("a <> b")
    if not twins.isEmpty():
        links.edges = twins if links.edges is None else links.edges.union(twins)
        links.of = C.stored(components(links.edges))
    found = links.labelled(member.groupBy("doc_id").agg(F.min("rep").alias("rep")), "rep", "component_id").select("doc_id", "component_id")
    out = sketch.select("doc_id", "n_shingles").join(found, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(df: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of ``df`` (with doc_id and text) but for near copies: the smallest id of each
    component stays, once if its row is repeated. Of rows that share an id but not a text each counts as a document of its
    own, in the order of their texts' hashes. Rows without an id stay."""
    named, unnamed = df.where("doc_id is not null"), df.where("doc_id is null")
    if named.groupBy("doc_id").count().where("count > 1").isEmpty():
        kept = near_duplicates(named, percent=percent).where("kept").select("doc_id")
        return named.join(kept, "doc_id", "left_semi").select(*df.columns).unionByName(unnamed)
    number = C.free_name(df.columns, "number")
    numbered = C.stored(named.orderBy("doc_id", F.xxhash64("text")).withColumn(number, F.monotonically_increasing_id()))  # grows with the id
    kept = near_duplicates(numbered.select(F.col(number).alias("doc_id"), "text"), percent=percent).where("kept").select(F.col("doc_id").alias(number))
    kept = numbered.join(kept, number, "left_semi")
    wordless = kept.where(F.coalesce(F.trim(F.translate("text", "\t\n\v\f\r", "     ")), F.lit("")) == "")
    rest = kept.join(wordless.select(number), number, "left_anti")
    return rest.select(*df.columns).unionByName(wordless.dropDuplicates(["doc_id"]).select(*df.columns)).unionByName(unnamed)
