"""The pipeline's stages on a small corpus, each against what its operator alone decides."""

import random
import zlib

import corpus_pipeline as P
import numpy as np
import pytest
from test_operators import ODD, shingles, text, tongue

from candela.llm import packing


def test_stages_follow_each_other(spark, tmp_path):
    rng = random.Random(3)
    item = text(rng, 30)
    rows = [(k, text(rng, 80)) for k in range(10, 90)]
    rows += [(200, text(rng, 40) + " " + item + " " + text(rng, 40)), (300, rows[0][1]), (301, rows[0][1] + " end")]
    rows += [(400 + k, " ".join([rng.choice("abc")] * 60)) for k in range(30)] + ODD
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 400), 0) for i, _ in rows if i and i >= 10], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for name, stage in P.STAGES[:-1]:
        docs = P.common.stored(stage(spark, docs, str(tmp_path)))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append((name, {r["doc_id"]: r["text"] for r in docs.collect()}))
    quality, language, near, clean = (k for _, k in kept)
    assert not any(400 <= (i or 0) < 500 for i in quality) and set(range(10, 90)) <= set(quality)
    assert not {2, 3} & set(language) and set(range(10, 90)) <= set(language)
    assert 10 in near and not {300, 301} & set(near)
    assert 200 in near and 200 not in clean and set(range(10, 90)) <= set(clean)
    assert not any(len(shingles(t) & shingles(item)) >= 0.8 * len(shingles(item)) for t in clean.values())
    packed = P.run(spark, str(tmp_path))
    pieces = {}
    for r in packed.collect():
        pieces.setdefault(r["doc_id"], []).append(r)
    assert set(pieces) == set(clean)
    base = packing.tokenizer().base
    for i, t in clean.items():
        ids = [*base.encode(t or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)


NAMES = "score string, predicted string, lang_pred string, body string, __text string, row string, rep string, key string, number string, words string, salt string, n string"


def tables(spark, folder, rows, labels, items):
    extra = len(NAMES.split(", "))
    schema = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {NAMES}"
    spark.createDataFrame([(i, t, x, "s", len(t or ""), *["x"] * extra) for i, t, x in rows], schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int, text string").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string, doc_id string").write.parquet(f"{folder}/benchmark.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_stages_take_odd_tables(spark, tmp_path):
    """Repeated ids with equal and different texts, nulls everywhere, names that clash."""
    rng = random.Random(5)
    a, b, c = (tongue(rng, "aa", 60) for _ in range(3))
    rows = [(k, tongue(rng, "aa", 50), "de") for k in range(20, 60)] + [(1, a, "de"), (1, b, None), (2, a + " kata", "de"), (3, c, "de"), (3, c, "de"), (None, b, "de"), (4, None, None), (4, "", "de"), (5, "12 34", "fr")]
    docs = tables(spark, tmp_path, rows, [(k, 1, 0, None) for k in range(20, 60)] + [(None, 1, None, "x"), (3, None, None, "x")], [(1, tongue(rng, "bb", 20), "x"), (2, None, None), (None, "a b c d e f", "x")])
    columns = docs.columns
    for name, stage in P.STAGES[:-1]:
        docs = P.common.stored(stage(spark, docs, str(tmp_path)))
        assert docs.columns == columns, name
    left = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(t for i, t in left if i in (1, 2, 3)) == sorted([a, b, c]) and {i for i, t in left if t in (a, b)} == {1, None}
    assert set(range(20, 60)) <= {i for i, _ in left} and not {4, 5} & {i for i, _ in left}
    packed = P.STAGES[-1][1](spark, docs, str(tmp_path))
    assert packed.count() >= len(left)


@pytest.mark.parametrize("empty", ["documents", "labels", "benchmark"])
def test_stages_take_empty_tables(spark, tmp_path, empty):
    rng = random.Random(6)
    rows = [(k, tongue(rng, "aa", 40), "de") for k in range(12)]
    docs = tables(spark, tmp_path, [] if empty == "documents" else rows, [] if empty == "labels" else [(k, k % 2, 0, None) for k in range(12)], [] if empty == "benchmark" else [(1, tongue(rng, "bb", 20), "x")])
    out = P.run(spark, str(tmp_path))
    assert "sequence_id" in out.columns
    if empty == "documents":
        assert out.count() == 0
    else:
        kept = {r["doc_id"] for r in P.quality_stage(spark, docs, str(tmp_path)).collect()}
        assert {r["doc_id"] for r in out.collect()} == kept and (empty != "labels" or kept == set(range(12)))
