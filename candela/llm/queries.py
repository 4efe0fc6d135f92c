"""The registered queries of the corpus operators and the SQL that some of them equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import ann, decontam, html, langid, lmscore, neardup, packing, quality, toxicity, warc


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_texts(C.table(spark, sf_dir, "documents"), with_ids=False).drop("loss_tokens")


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(C.table(spark, sf_dir, "documents"), percent=85)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = C.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = C.crc_mod(F.col("doc_id"), 3) == 1
    profiles = langid.fit(documents, ~held_out)
    return langid.predict(documents.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text"), profiles).drop("text")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(documents, C.table(spark, sf_dir, "labels"))
    held_out = F.coalesce(C.crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    return quality.score(documents.select("doc_id", held_out.alias("held_out"), "text"), model, threshold=0.3).drop("text")


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(C.table(spark, sf_dir, "pages"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(C.table(spark, sf_dir, "pages")).drop("position")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    grammar = toxicity.fit(documents, C.table(spark, sf_dir, "labels"))
    held_out = F.coalesce(C.crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    return toxicity.score(documents.select("doc_id", held_out.alias("held_out"), "text"), grammar, threshold=0.5).drop("text")


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = C.crc_mod(F.col("doc_id"), 7) == 2
    counts = lmscore.count(documents, ~held_out)
    return lmscore.score(documents, held_out, counts, lmscore.fit(counts))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(C.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


QUERIES = {f.__name__: f for f in (op1_packing, op2_near_duplicates, op3_decontamination, op4_language, op5_main_text, op6_warc, op7_quality, op8_toxicity, op9_language_model, op10_nearest)}
SHINGLES = r"""
d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id)"""
NEAR_DUPLICATES = f"""WITH RECURSIVE {SHINGLES},
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.other = l.a)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id"""
WARC = """WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS b FROM pages), f AS (SELECT h, min(page_id) AS first FROM p WHERE b >= 100 GROUP BY h)
SELECT page_id, CAST(b AS BIGINT) AS payload_bytes, sha256(p.h) AS payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM p LEFT JOIN f ON p.h = f.h"""
ORACLES = {"op2_near_duplicates": NEAR_DUPLICATES, "op3_decontamination": decontam.ORACLE, "op6_warc": WARC}
