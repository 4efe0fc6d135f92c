"""Approximate nearest neighbours by cosine: an inverted file with product-quantised residuals.

Vectors are scaled to length 1. Coarse centroids split them into lists, four times the root of the number of
rows; every vector stands in the SPILL lists whose centroids are nearest, and what is left after each
centroid is quantised in PARTS parts of 256 codes. A query visits its nearest lists, picks a shortlist of
each by asymmetric distance tables, and reranks those exactly, in double precision on the original
vectors. Centroids and codes are fitted on at most SAMPLE vectors; every row is indexed. How many lists
have to be visited depends on the data (few where they form clusters, up to a third where they are random),
so it is measured when the index is fitted: the fewest that hold the share RECALL of the neighbours in the sample. Those are
farther than the neighbours among all rows, which makes it a cautious figure.

Equal vectors are kept as one entry that stands for its smallest ids, as many as any answer can hold,
so that a vector that makes up a third of all rows costs no more than another. Lists are dealt out in
blocks of bounded size, small lists together, long ones in parts; a query travels once to each block that has a list of
its own. Queries that have met fewer than k neighbours visit all lists.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: The most vectors that the index is fitted on, and the most lists, which bounds what is broadcast.
SAMPLE, LISTS = 20_000, 4_096
#: Lists that a vector stands in.
SPILL = 2
#: Share of the nearest neighbours within the sample that the lists visited have to hold.
RECALL = 0.96
#: Rows that are dealt out together, and queries that meet one block in a task.
BLOCK, QUERIES = 8_192, 8_192
#: Queries whose distances to a block are held at once.
HELD = 256
CODES = 256


class Index(NamedTuple):
    centroids: np.ndarray
    codebooks: np.ndarray  # part x code x width
    padding: int


def nearest(x: np.ndarray, centres: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` nearest centres of each row, nearest first."""
    out = np.empty((len(x), min(k, len(centres))), np.int64)
    norms = (centres**2).sum(axis=1)
    for a in range(0, len(x), 2048):
        distance = norms - 2 * (x[a : a + 2048] @ centres.T)
        if out.shape[1] == 1:
            out[a : a + 2048, 0] = distance.argmin(axis=1)
            continue
        near = np.argpartition(distance, out.shape[1] - 1, axis=1)[:, : out.shape[1]]
        order = np.argsort(np.take_along_axis(distance, near, axis=1), axis=1, kind="stable")
        out[a : a + 2048] = np.take_along_axis(near, order, axis=1)
    return out


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Lloyd's algorithm from a random start; empty clusters move to random rows."""
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:k]].astype(np.float32)
    for _ in range(rounds):
        near = nearest(x, centres, 1)[:, 0]
        order = np.argsort(near, kind="stable")
        met, first = np.unique(near[order], return_index=True)
        fresh = x[rng.integers(0, len(x), len(centres))].astype(np.float64)
        fresh[met] = np.add.reduceat(x[order].astype(np.float64), first, axis=0) / np.diff(np.append(first, len(x)))[:, None]
        centres = fresh.astype(np.float32)
    return centres


def fit(x: np.ndarray, lists: int, parts: int) -> Index:
    """Fit on vectors of length 1."""
    padding = -x.shape[1] % parts
    x = np.pad(x, ((0, 0), (0, padding))).astype(np.float32)
    centroids = kmeans(x, min(lists, len(x)))
    left = x - centroids[nearest(x, centroids, 1)[:, 0]]
    width = x.shape[1] // parts
    return Index(centroids, np.stack([kmeans(left[:, p * width : (p + 1) * width], min(CODES, len(x)), 8, p) for p in range(parts)]), padding)


def encode(x: np.ndarray, near: np.ndarray, index: Index) -> np.ndarray:
    width = index.codebooks.shape[2]
    left = x - index.centroids[near]
    return np.stack([nearest(left[:, p * width : (p + 1) * width], book, 1)[:, 0] for p, book in enumerate(index.codebooks)], axis=1).astype(np.uint8)


def tables(queries: np.ndarray, index: Index) -> np.ndarray:
    """Dot products (part x code x query) of the queries with every code."""
    return np.einsum("qpw,pcw->pcq", queries.reshape(len(queries), len(index.codebooks), -1), index.codebooks, optimize=True)


def decoded(lists: np.ndarray, codes: np.ndarray, index: Index) -> np.ndarray:
    """What rows are quantised to: centroid and codes together."""
    return index.centroids[lists] + np.concatenate([book[codes[:, p]] for p, book in enumerate(index.codebooks)], axis=1)


def probes_needed(x: np.ndarray, index: Index, k: int, spill: int, recall: float) -> int:
    """The fewest lists, nearest first, that hold the share ``recall`` of the ``k`` nearest neighbours within the sample ``x``."""
    x = np.pad(x, ((0, 0), (0, index.padding))).astype(np.float32)
    asked = np.unique(np.linspace(0, len(x) - 1, 512).astype(int))
    near, order = nearest(x, index.centroids, spill), nearest(x[asked], index.centroids, len(index.centroids))
    need = []
    for row, own in zip(asked, order):
        place = np.empty(len(own), np.int64)
        place[own] = np.arange(len(own))
        score = x @ x[row]
        score[row] = -np.inf
        best = np.argsort(-score, kind="stable")[: min(k, len(x) - 1)]
        need += place[near[best]].min(axis=1).tolist()
    return int(np.quantile(need, recall, method="higher")) + 1 if need else 1


def cosines(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Double precision, the same for equal vectors wherever they stand. Rows of ``vectors`` may be grouped, with a
    row of ``query`` for each group."""
    dots = np.multiply(vectors, query[..., None, :]).sum(axis=-1)
    return dots / (np.sqrt(np.multiply(query, query).sum(axis=-1))[..., None] * np.sqrt(np.multiply(vectors, vectors).sum(axis=-1)))


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _units(batch: pa.RecordBatch, dimension: int, index: Index) -> np.ndarray:
    vectors = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension).astype(np.float64)
    return np.pad(vectors / np.sqrt((vectors**2).sum(axis=1))[:, None], ((0, 0), (0, index.padding))).astype(np.float32)


def _coded(index: Index, spill: int, dimension: int):
    """Entries with their nearest lists and the codes of what is left after each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                unit = _units(batch, dimension, index)
                near = nearest(unit, index.centroids, spill)
                codes = [encode(unit, near[:, j], index) for j in range(near.shape[1])]
                places = [[{"list": int(l), "codes": c[row].tobytes()} for l, c in zip(near[row], codes)] for row in range(len(near))]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.list_(pa.struct([("list", pa.int64()), ("codes", pa.binary())])))], names=[*batch.schema.names, "places"])

    return run


def _visiting(index: Index, probes: int, group: np.ndarray, dimension: int):
    """Queries with the groups of lists that they visit, and which lists of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = np.sort(nearest(_units(batch, dimension, index), index.centroids, probes), axis=1)
                visits = []
                for own in near:
                    of = group[own]
                    own, of = own[of >= 0], of[of >= 0]  # lists without a row have no group
                    edge = np.flatnonzero(np.diff(of, prepend=-1))
                    visits.append([{"group": int(of[a]), "lists": l} for a, l in zip(edge, np.split(own, edge[1:]))])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(visits, pa.list_(pa.struct([("group", pa.int32()), ("lists", pa.list_(pa.int64()))])))], names=[*batch.schema.names, "visits"])

    return run


def _searched(index: Index, k: int, shortlist: int):
    """Of a block and the queries that visit lists in it, each query's best entries, enough for ``k`` different ids:
    asymmetric distances pick the shortlist, exact cosines its best."""

    def distances(unit, visits, bounds, codes, centroids, fixed):
        """Squared asymmetric distances (less the query's own square) to the rows of the lists that a query visits, else infinite."""
        by_part, to_centroid = tables(unit, index), unit @ centroids.T
        out = np.full((len(unit), len(codes)), np.inf, np.float32)
        for l in np.flatnonzero(visits.any(axis=0)):
            own, (a, z) = np.flatnonzero(visits[:, l]), bounds[l : l + 2]
            dots = np.repeat(to_centroid[own, l][None], z - a, axis=0)
            for p, table in enumerate(by_part):
                dots += table[:, own].take(codes[a:z, p], axis=0)
            out[own, a:z] = fixed[a:z] - 2 * dots.T
        return out

    def run(key, queries, block):
        import pandas as pd

        out: dict[str, list] = {"query": [], "ids": [], "score": []}
        if len(queries) and len(block):
            block = block.sort_values("list", kind="stable")
            vectors = np.array(block["v"].tolist(), np.float64)
            codes = np.frombuffer(b"".join(block["codes"]), np.uint8).reshape(len(block), -1)
            entry, ids, rows = block["entry"].to_numpy(), block["ids"].tolist(), block["list"].to_numpy()
            lists, first, of = np.unique(rows, return_index=True, return_inverse=True)
            bounds = np.append(first, len(rows))
            fixed = (decoded(rows, codes, index) ** 2).sum(axis=1)
            once = np.unique(block["mark"].to_numpy(), return_index=True)[1]
            flat = np.concatenate([ids[o] for o in once])
            short = len(block) if len(np.unique(flat)) < len(flat) else min(shortlist, len(block))  # where an id has several vectors, all rows are reranked
            asked, names = np.array(queries["qv"].tolist(), np.float64), queries["query"].to_numpy()
            wanted = queries["lists"].tolist()
            held = max(1, HELD * min(shortlist, short) // short)
            for a in range(0, len(asked), held):
                v, visits = asked[a : a + held], np.zeros((len(asked[a : a + held]), len(lists)), bool)
                for row, own in enumerate(wanted[a : a + held]):
                    visits[row] = np.isin(lists, own, assume_unique=True)
                unit = np.pad(v / np.sqrt((v**2).sum(axis=1))[:, None], ((0, 0), (0, index.padding))).astype(np.float32)
                distance = distances(unit, visits, bounds, codes, index.centroids[lists], fixed)
                best = np.argpartition(distance, short - 1, axis=1)[:, :short] if short < len(block) else np.broadcast_to(np.arange(len(block)), (len(v), len(block)))
                exact = np.where(np.isfinite(np.take_along_axis(distance, best, axis=1)), cosines(v, vectors[best]), -np.inf)
                order = np.lexsort((entry[best], -exact), axis=1)
                for row, name in enumerate(names[a : a + held].tolist()):
                    known: set[int] = set()
                    for o in order[row]:
                        if len(known) >= k or exact[row, o] == -np.inf:
                            break
                        own = ids[best[row, o]]
                        known.update(own.tolist())
                        out["query"].append(name), out["ids"].append(own), out["score"].append(exact[row, o])
        return pd.DataFrame(out).astype({"query": "int64", "score": "float64"})

    return run


def grouped(sizes: dict[int, int], lists: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The group of each list (-1 without rows) and (group, blocks): neighbours in number share a group of up to BLOCK
    rows, a longer list has one of its own in several blocks."""
    group, blocks, room = np.full(lists, -1), [], 0
    for number in sorted(sizes):
        if sizes[number] > room or not blocks:
            blocks.append((len(blocks), -(-sizes[number] // BLOCK)))
            room = max(0, BLOCK - sizes[number])
        else:
            room -= sizes[number]
        group[number] = len(blocks) - 1
    return group, blocks


def search(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", lists: int | None = None, probes: int | None = None, parts: int = 16, shortlist: int = 64, sample: int = SAMPLE, spill: int = SPILL, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row the ``k`` nearest of the other rows found.

    Rows whose id or vector is null, zero, of another length than most or with null or non-finite
    components take no part; ``lists`` and ``probes``, the number of lists and of those that a query visits, are chosen
    from the data by default; rows that repeat an id and vector count once, and an id with several
    vectors by the one that is nearest; ties go to the smaller id; fewer rows than ``k`` give all; an empty table gives no rows."""
    spark = df.sparkSession
    kind = "float" if df.select(vector_col).schema[0].dataType.simpleString() == "array<float>" else "double"
    usable = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast(f"array<{kind}>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    usable = usable.where(F.col("id").isNotNull() & _usable(F.col("v"))).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0).cast(kind)))
    usable = C.stored(usable.groupBy("id", "v").agg(F.max("asks").alias("asks")))
    sizes = usable.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    dimension = int(sizes["d"])
    usable = usable.where(F.size("v") == dimension)
    chosen = usable.select("v", "id").orderBy(F.xxhash64("id"), "id", "v").limit(sample).select("v").toArrow().column("v").combine_chunks()
    fitted = chosen.flatten().to_numpy().astype(np.float64).reshape(-1, dimension)
    fitted = np.unique(fitted / np.sqrt((fitted**2).sum(axis=1))[:, None], axis=0)
    index = fit(fitted, min(LISTS, lists or max(8, int(4 * sizes["count"] ** 0.5))), parts)
    spill = min(spill, len(index.centroids))
    probes = min(len(index.centroids), probes or probes_needed(fitted, index, k, spill, recall))
    row = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    first = usable.select("id", "v").withColumn("n", row).where(F.col("n") <= k + 1)  # Spark limits the rank before it shuffles
    entries = first.groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("ids")).withColumn("entry", F.col("ids")[0])
    coded = entries.mapInArrow(_coded(index, spill, dimension), f"v array<{kind}>, ids array<bigint>, entry bigint, places array<struct<list:bigint,codes:binary>>")
    coded = C.stored(coded.select("v", "ids", "entry", F.explode("places").alias("p")).select("v", "ids", "entry", F.xxhash64("v").alias("mark"), "p.list", "p.codes"))
    group, blocks = grouped({r["list"]: r["count"] for r in coded.groupBy("list").count().collect()}, len(index.centroids))  # at most LISTS rows
    places = spark.createDataFrame([(n, int(g)) for n, g in enumerate(group) if g >= 0], "list bigint, group int")
    blocks = spark.createDataFrame(blocks, "group int, blocks int")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = usable.where("asks").groupBy("v").agg(F.min("id").alias("query"))  # equal queries are searched once

    def found(asked: DataFrame, probes: int) -> DataFrame:
        """(query, vec_id, score): the k + 1 best ids, the query's own among them."""
        visits = asked.select("query", F.col("v").alias("qv"), "v").mapInArrow(_visiting(index, probes, group, dimension), f"query bigint, qv array<{kind}>, v array<{kind}>, visits array<struct<group:int,lists:array<bigint>>>")
        visits = C.stored(visits.select("query", "qv", F.explode("visits").alias("x")).select("query", "qv", "x.group", "x.lists"))
        shares = C.stored(blocks.join(visits.groupBy("group").agg(F.ceil(F.count("*") / F.lit(QUERIES)).cast("int").alias("parts")), "group"))  # at most LISTS rows
        sent = visits.join(F.broadcast(shares), "group").select("query", "qv", "lists", F.col("group").alias("qgroup"), F.pmod(F.xxhash64("query"), F.col("parts")).cast("int").alias("qpart"), numbers("blocks").alias("qblock"))
        held = coded.join(F.broadcast(places), "list").join(F.broadcast(shares), "group")
        held = held.select("v", "ids", "entry", "mark", "codes", "list", "group", F.pmod(F.xxhash64("entry", "v"), F.col("blocks")).cast("int").alias("block"), numbers("parts").alias("part"))
        best = sent.groupBy("qgroup", "qblock", "qpart").cogroup(held.groupBy("group", "block", "part")).applyInPandas(_searched(index, k + 1, max(shortlist, spill * (k + 1))), "query bigint, ids array<bigint>, score double")
        best = best.select("query", F.explode("ids").alias("vec_id"), "score").groupBy("query", "vec_id").agg(F.max("score").alias("score"))
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
        return C.stored(best.withColumn("n", rank).where(F.col("n") <= k + 1).drop("n"))

    top = found(asked, probes)
    if probes < len(index.centroids):
        few = asked.join(top.groupBy("query").count().where(F.col("count") > k), "query", "left_anti")
        if not few.isEmpty():
            top = top.join(few, "query", "left_anti").unionByName(found(few, len(index.centroids)))
    twins = usable.where("asks").select(F.col("id").alias("query_id"), "v").join(asked, "v").select("query_id", "query").distinct()
    each = twins.join(top, "query").where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
