"""Benchmark items inside documents: size-partitioned MinHash containment search, native operators only.

A short item hidden in a long document has a tiny similarity to the whole document, so a sketch of
the document can't find it. The sketch is taken on the item's side: items are partitioned by the
power of two that bounds their shingle count, and each keeps the smallest min-wise hashes of its
shingles, as many as its partition's bound needs. An item of n shingles of which a share t must occur
can miss floor((1 - t) * n) of them, so one more minimum than that always leaves one to be met: the
search loses nothing. Every shingle of every document probes the index of minima; the pairs that
meet are confirmed by the exact containment of word shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The index of minima is broadcast up to this many rows of two longs, else joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: Copies of the index in that join, so that no task meets a shingle that many documents share in all of them.
SALTS = 16


def words(text: Column) -> Column:
    """Words of a text, A-Z in lower case; null gives none."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def shingle_hashes(hashes: str, width: int) -> Column:
    """64-bit hashes of the shingles over a column of word hashes; fewer words make one shingle."""
    terms = ", ".join(f"{hashes}[i + {k}]" for k in range(width))
    return F.expr(
        f"case when size({hashes}) = 0 then cast(array() as array<bigint>) when size({hashes}) < {width} then array(xxhash64({hashes}))"
        f" else transform(sequence(0, size({hashes}) - {width}), i -> xxhash64({terms})) end"
    )


def shingle_strings(tokens: str, width: int) -> Column:
    """Distinct shingles as strings."""
    return F.expr(f"case when size({tokens}) = 0 then cast(array() as array<string>) else array_distinct(transform(sequence(1, greatest(size({tokens}) - {width - 1}, 1)), i -> array_join(slice({tokens}, i, {width}), ' '))) end")


def contained(documents: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", threshold: float = 0.8, width: int = 5) -> DataFrame:
    """(doc_id, item_id, shared, total, containment): items of which at least ``threshold`` of the
    distinct shingles occur in the document.

    Null and empty texts hold nothing; a text of fewer than ``width`` words is one shingle, so such an
    item is only found as a whole document; rows without an id are left out; of rows that repeat an
    id the best containment counts; empty tables give no rows; other columns are ignored."""
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("body")).where("doc_id is not null")
    item = items.select(F.col(item_col).alias("item_id"), words(F.col(item_text)).alias("tokens")).where("item_id is not null and size(tokens) > 0")
    item = item.withColumn("hashes", F.transform("tokens", lambda w: F.xxhash64(w))).select("item_id", shingle_strings("tokens", width).alias("shingles"), F.array_distinct(shingle_hashes("hashes", width)).alias("keys"))
    bound = F.pow(F.lit(2.0), F.ceil(F.log2(F.size("keys").cast("double"))))
    needed = (F.floor(F.lit(1 - threshold) * bound + F.lit(1e-9)) + 1).cast("int")
    ranked = F.array_sort(F.transform("keys", lambda k: F.struct(F.xxhash64(k, F.lit(17)).alias("h"), k.alias("k"))))
    index = item.select("item_id", F.explode(F.slice(F.transform(ranked, lambda x: x["k"]), F.lit(1), needed)).alias("key"))
    probes = docs.select("doc_id", F.transform(words(F.col("body")), lambda w: F.xxhash64(w)).alias("hashes")).select("doc_id", F.explode(shingle_hashes("hashes", width)).alias("key"))
    if index.count() <= BROADCAST_ROWS:
        met = probes.join(F.broadcast(index), "key")
    else:  # the shingles of a common passage are dealt out to copies of the index
        salted = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = probes.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"])
    candidates = met.select("doc_id", "item_id").distinct()
    pairs = candidates.groupBy("doc_id").agg(F.collect_set("item_id").alias("items"))
    texts = docs.join(pairs, "doc_id").select("doc_id", "items", words(F.col("body")).alias("tokens"))
    checked = texts.select("doc_id", "items", shingle_strings("tokens", width).alias("own")).select("doc_id", F.explode("items").alias("item_id"), "own")
    share = checked.join(item.select("item_id", "shingles"), "item_id").select("doc_id", "item_id", F.size(F.array_intersect("shingles", "own")).cast("bigint").alias("shared"), F.size("shingles").cast("bigint").alias("total"))
    share = share.groupBy("doc_id", "item_id").agg(F.max(F.struct(F.col("shared") / F.col("total"), "shared", "total")).alias("x")).select("doc_id", "item_id", "x.shared", "x.total")
    return share.where(F.col("shared") >= F.lit(threshold) * F.col("total") - F.lit(1e-9)).withColumn("containment", F.round(F.col("shared") / F.col("total"), 6))


def decontaminated(documents: DataFrame, items: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The documents (doc_id, text, ...) that contain no item. Null and empty texts and rows without an id stay; rows that
    repeat an id go together if one of their texts contains an item; empty tables take nothing away; other columns are
    passed through."""
    return documents.join(contained(documents, items, threshold=threshold).select("doc_id").distinct(), "doc_id", "left_anti").select(*documents.columns)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL
), i AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL
), ds AS (
  SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM d WHERE len(w) > 0)
), s AS (
  SELECT DISTINCT item_id, array_to_string(w[k:k + 4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM i WHERE len(w) > 0)
), t AS (SELECT item_id, count(*) AS total FROM s GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS shared, any_value(total) AS total, round(count(*) / any_value(total), 6) AS containment
FROM ds JOIN s USING (s) JOIN t USING (item_id) GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * any_value(total) - 1e-9
"""
