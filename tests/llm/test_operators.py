"""The corpus operators on small tables, against brute force and on what tables may hold: nulls, empty and very long
texts, ties and repeated rows, no rows, and columns whose names clash."""

import gzip
import hashlib
import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from candela.llm import ann, decontam, html, langid, lmscore, neardup, packing, quality, toxicity, warc
from candela.llm import common as C

WORDS = [a + b for a in "the of and re in on ti er".split() for b in "ba ko mi zu lo na".split()]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def docs(spark, rows, extra=""):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, row string, rep string, key string, words string"
    return spark.createDataFrame([(i, t, "en", "s", 0, "x", "x", "x", "x", "x") for i, t in rows], schema)


ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (None, "a b c d e f"), (5, "Ünï cödé ñ " * 3), (6, "x" * 5000), (7, "same text as the next one here"), (8, "same text as the next one here"), (8, "same text as the next one here")]
LONG = [(9, "word " * 60_000)]


def shingles(t, width=5):
    w = [x.lower() for x in (t or "").encode().split()]
    return {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


# hashing ---------------------------------------------------------------------------------------------------------------


def test_word_hashes_follow_words():
    data = "A the  THE\tThe\nñ Ñ x\x0by".encode()
    h = C.word_hashes(data)
    assert len(h) == len(data.split()) and h[1] == h[2] == h[3] and h[4] != h[5]
    assert len(C.word_hashes(b"")) == len(C.word_hashes(b" \n")) == 0
    assert len(C.shingle_set(C.word_hashes(b"a b c"))) == 1 and len(C.shingle_set(C.word_hashes(b"a b c d e f"))) == 2


# packing ---------------------------------------------------------------------------------------------------------------


def check_packing(pieces, want, limits):
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    for doc, ids in want.items():
        own = sorted(by_doc[doc], key=lambda p: p["start"])
        at = 0
        for p in own:
            assert p["start"] == at and p["doc_tokens"] == len(ids) and list(p["ids"]) == ids[at : at + p["length"]]
            assert p["ids_crc32"] == zlib.crc32(np.array(p["ids"], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids)
    for own in by_sequence.values():
        own.sort(key=lambda p: p["offset"])
        total = 0
        for p in own:
            assert p["offset"] == total
            total += p["length"]
        assert total <= limits.tokens and len(own) <= limits.segments and sum(p["loss_tokens"] for p in own) <= limits.loss_tokens
        assert total == limits.tokens or total & (total - 1) == 0


def test_packing_round_trip(spark):
    rng = random.Random(1)
    data = [*ODD[:4], *ODD[5:9], *LONG, *((100 + k, text(rng, rng.randint(1, 900))) for k in range(60))]
    got = [r.asDict() for r in packing.pack_texts(docs(spark, data)).collect()]
    base = packing.tokenizer().base
    check_packing(got, {i: [*base.encode(t or "", add_special_tokens=False).ids, 1] for i, t in data}, packing.Limits())
    assert packing.pack_texts(docs(spark, [])).count() == 0


def test_packing_words_match_the_tokenizer():
    own = packing.tokenizer()
    odd = ["don't we'll x's", "İstanbul ΣΑΣ K Å", "a<|endoftext|>b <|startoftext|>", "é e ́x", "tok=\"0641\" 12,5€ %%%", " em space　", "naïve façade—dash…", "😀🎉 日本語 текст"]
    for t, ids in zip(odd, own.encode(odd)):
        assert np.frombuffer(ids, "<u4").tolist() == own.base.encode(t, add_special_tokens=False).ids, t


def test_packing_keeps_every_limit(spark):
    rows = [(k, [("question " * (k % 7 + 1), False), ("answer " * (k * 13 % 90 + 1), True)]) for k in range(80)]
    df = spark.createDataFrame(rows, "doc_id bigint, segments array<struct<text:string,loss:boolean>>")
    limits = packing.Limits(128, 5, 64)
    got = [r.asDict() for r in packing.pack_examples(df.coalesce(1), limits=limits).collect()]
    base = packing.tokenizer().base
    check_packing(got, {i: [x for t, _ in s for x in base.encode(t, add_special_tokens=False).ids] + [1] for i, s in rows}, limits)
    turns = spark.createDataFrame([(1, 2, "assistant", "yes"), (1, 1, "user", "really"), (2, 1, "user", None)], "conv_id bigint, turn bigint, role string, text string")
    assert {r["doc_id"]: r["loss_tokens"] for r in packing.pack_examples(packing.conversation_examples(turns)).groupBy("doc_id").agg(F.sum("loss_tokens").alias("loss_tokens")).collect()} == {1: 2, 2: 0}


# near duplicates -------------------------------------------------------------------------------------------------------


def brute_components(rows, percent):
    parent = {i: i for i, _ in rows if i is not None}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in parent}


def variants(rng, base, n, most):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(rng.randint(0, most)):
            w[rng.randrange(len(w))] = rng.choice(WORDS) + str(rng.random())[2:6]
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("small", [24, 2])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(neardup, "SMALL_BUCKET", small)
    monkeypatch.setattr(neardup, "BLOCK", 16)
    monkeypatch.setattr(neardup, "BROADCAST_ROWS", 3 if small == 2 else 200_000)
    monkeypatch.setattr(neardup, "SHARE", 4 if small == 2 else 500)
    rng = random.Random(5)
    many = variants(rng, text(rng, 150), 60, 8)
    rows = [*ODD, *LONG, *((100 + k, t) for k, t in enumerate(many)), *((300 + k, text(rng, 80)) for k in range(20)), (400, many[0].upper()), (401, text(rng, 3)), (402, "one")]
    got = neardup.near_duplicates(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    want = brute_components(rows, 85)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert r["component_id"] == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])
    sizes = {i: len(shingles(t)) for i, t in rows}
    assert all(r["n_shingles"] == sizes[r["doc_id"]] for r in got)


def test_near_duplicates_of_nothing(spark):
    assert neardup.near_duplicates(docs(spark, [])).count() == 0
    assert neardup.near_duplicates(docs(spark, [(1, None), (2, "")])).where("kept").count() == 2


def test_one_of_a_group_stays(spark):
    left = neardup.keep_one(docs(spark, ODD))
    assert sorted((r["doc_id"] or 0) for r in left.collect()) == [0, 1, 2, 3, 4, 5, 6, 7]
    assert left.columns == docs(spark, ODD).columns


def test_different_texts_of_an_id_stay(spark):
    rng = random.Random(21)
    a, b, c = (text(rng, 40) for _ in range(3))
    rows = [(1, a), (1, b), (2, a + " end"), (2, c), (3, b), (4, None), (4, None), (4, " "), (5, ""), (None, a), (6, a), (6, a)]
    left = [(r["doc_id"], r["text"]) for r in neardup.keep_one(docs(spark, rows)).collect()]
    assert sorted(t for i, t in left if i in (1, 2, 3, 6)) == sorted([a, b, c]) and {i for i, t in left if t in (a, b)} == {1, None}
    assert sorted(i for i, t in left if i in (4, 5)) == [4, 5] and (None, a) in left
    assert neardup.keep_one(docs(spark, [])).count() == 0


@pytest.mark.parametrize("rows", [200_000, 3])
def test_components_of_chains_and_stars(spark, monkeypatch, rows):
    monkeypatch.setattr(neardup, "BROADCAST_ROWS", rows)
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 140)] + [(200, 201)]
    got = dict(tuple(r) for r in neardup.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert got == {**{k: 1 for k in range(1, 41)}, **{k: 100 for k in range(100, 140)}, 200: 200, 201: 200}


# decontamination -------------------------------------------------------------------------------------------------------


def test_contained_items_equal_brute_force(spark):
    rng = random.Random(7)
    items = [(k, text(rng, rng.randint(3, 60))) for k in range(25)] + [(90, None), (91, ""), (92, "one")]
    rows = [*ODD, *LONG]
    for k in range(60):
        i, t = rng.choice(items[:25])
        w = t.split()
        for _ in range(rng.choice([0, 0, 1, 2, 9])):
            w[rng.randrange(len(w))] = "zzz"
        rows.append((100 + k, text(rng, rng.randint(0, 300)) + " " + " ".join(w).upper() + "\n" + text(rng, 40)))
    rows += [(200, items[0][1]), (201, "ONE"), (200, "something else entirely here now")]
    bench = spark.createDataFrame([(i, t, "x", "y") for i, t in items], "item_id bigint, text string, doc_id string, shared string")
    got = {(r["doc_id"], r["item_id"]): (r["shared"], r["total"]) for r in decontam.contained(docs(spark, rows), bench).collect()}
    want = {}
    for i, t in rows:
        own = shingles(t)
        for j, u in items:
            s = shingles(u)
            if i is not None and s and len(own & s) >= 0.8 * len(s):
                want[i, j] = max(want.get((i, j), (0, 0)), (len(own & s), len(s)))
    assert got == want and want
    left = {r["doc_id"] for r in decontam.decontaminated(docs(spark, rows), bench).collect()}
    assert left == {i for i, _ in rows} - {i for i, _ in want}
    assert decontam.contained(docs(spark, []), bench).count() == decontam.contained(docs(spark, rows), bench.limit(0)).count() == 0


# language --------------------------------------------------------------------------------------------------------------

SYLLABLES = {"aa": "ka ta na ra sa".split(), "bb": "zu du gü mu bu".split(), "cc": "ri li ñi vi di".split()}


def tongue(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_languages_are_told_apart(spark):
    rng = random.Random(2)
    rows = [(k, tongue(rng, lang, rng.randint(3, 60)), lang) for k, lang in enumerate(["aa", "bb", "cc"] * 60)] + [(900, None, "aa"), (901, "12 ++", "bb"), (902, "", None), (903, tongue(rng, "bb", 20_000).upper(), None), (None, "kata", "aa")]
    df = spark.createDataFrame([(i, t, x, "s") for i, t, x in rows], "doc_id bigint, text string, lang string, score string")
    profiles = langid.fit(df, C.crc_mod(F.col("doc_id"), 3) != 1)
    got = {r["doc_id"]: r for r in langid.predict(df, profiles).collect()}
    assert all(got[i]["lang_pred"] == x for i, t, x in rows[:180]) and all(0 <= r["score"] <= 1 for r in got.values())
    assert [got[i]["lang_pred"] for i in (900, 901, 902, 903)] == ["und", "und", "und", "bb"]
    none = langid.predict(df, langid.fit(df.limit(0), F.lit(True)))
    assert {r["lang_pred"] for r in none.collect()} == {"und"}
    assert langid.predict(df.limit(0), profiles).count() == 0


def test_cosines_equal_bundled_vectors():
    rng = np.random.default_rng(0)
    prototypes = rng.normal(size=(2, langid.DIMENSIONS))
    prototypes /= np.linalg.norm(prototypes, axis=1, keepdims=True)
    own = langid.Identifier(langid.Profiles(["a", "b"], prototypes))
    texts = ["The quick brown fox", "über", "a  b"]
    cos, lettered = own.cosines(texts)
    for t, row in zip(texts, cos):
        codes, _, _ = langid.trigram_codes([t])
        bundle = langid.trigram_vectors(codes).astype(float).sum(axis=0)
        exact = bundle @ prototypes.T / np.linalg.norm(bundle)
        assert np.allclose(row, exact, atol=0.02)
    assert lettered.all()


# html ------------------------------------------------------------------------------------------------------------------


def test_articles_without_their_furniture():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
    <header>H</header><nav><ul><li>M</ul></nav><div class="ad">buy</div><article><header><h1>Head&amp;line</h1></header><p>One <b>two
    three<br>four<p>Five &eacute;&#x41;<!-- no --> <a href='x'>link</a>.<ul><li>a<li>b</ul><aside>S</aside><form>F</form><div class="comments"><p>C</div><footer>F</footer></article><section id=comments>R</section><footer>&copy;</footer>"""
    got, _, _ = html.article(page)
    assert got == "Head&line One two three four Five éA link . a b".replace("link .", "link.")
    assert html.article(None)[0] == html.article("")[0] == ""
    assert html.article("plain < text & more")[1] == ["plain < text & more"]
    assert html.article("<p>open <script>x")[1] == ["open"]
    assert html.article("<article>" + "<p>" + "w " * 200_000)[0] == ("w " * 200_000).strip()


def test_templates_recur_on_a_host(spark):
    def page(k, body):
        return f"<html><body><div class=top><p>Welcome to our site</p></div><div><p>{body}</p><p>Extra words {k % 3}</p></div><div><p>All rights reserved</p></div></body></html>"

    rows = [(k, f"http://a.example/{k}", page(k, f"body number {k} " * 6)) for k in range(12)]
    rows += [(100 + k, "http://b.example/x", page(k, "copied body " * 8)) for k in range(12)]
    rows += [(200, None, None), (201, "x", ""), (1, "http://a.example/1", page(1, "body number 1 " * 6))]
    df = spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows], "page_id bigint, url string, html string, text string, host string")
    got = html.extract(df).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["page_id"] < 100:
            assert "body number" in r["text"] and "Welcome" not in r["text"] and "rights" not in r["text"]
        elif r["page_id"] < 200:
            assert "copied body" in r["text"] and "Welcome" in r["text"]
        else:
            assert r["text"] == ""
        assert r["n_chars"] == len(r["text"])
    assert html.extract(df.limit(0)).count() == 0


def test_templates_recur_inside_marked_articles(spark):
    """What recurs on a host goes from a marked article too, whatever its class."""

    def page(k):
        return f"<body><p>Outside</p><article><div class=hint><p>Read our offers of the week</p></div><p>{f'words of page {k} ' * 8}</p><p>Same for {k % 4}</p></article></body>"

    df = spark.createDataFrame([(k, "http://a.example/x", page(k)) for k in range(12)] + [(50, "http://b.example/x", page(50))], "page_id bigint, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.extract(df).collect()}
    assert got == {k: f"{f'words of page {k} ' * 8}Same for {k % 4}" for k in range(12)} | {50: f"Read our offers of the week {'words of page 50 ' * 8}Same for 2"}


def test_prose_of_marked_articles_stays(spark):
    """Paragraphs and headings that a site's articles repeat are their text; a box that recurs among them isn't."""
    rows = [(k, "http://a.example/x", f"<body><article><h1>Same title</h1><p><b>Of.</b><br><p>The same line again.</p><p>{f'words of page {k} ' * 5}</p><ul><li>Also.</ul><div><p>Read on</p></div><p class=hint>Hint</p></article></body>") for k in range(9)]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {k: f"Same title Of. The same line again. {f'words of page {k} ' * 5}".strip() for k in range(9)}


@pytest.mark.parametrize("broadcast", [200_000, -1])
def test_templates_of_large_hosts_and_long_notices(spark, monkeypatch, broadcast):
    """Neither the size of a host nor the length of a notice saves a template; copies keep their text."""
    monkeypatch.setattr(html, "BROADCAST_ROWS", broadcast)

    def page(advert, body):
        return f"<body><p>Our offer {advert}</p><p>{body}</p></body>"

    rows = [(k, "http://a.example/x", page(k % 8, f"a longer body of number {k}")) for k in range(48)]
    rows += [(100 + k, "http://b.example/x", page(0, "copied body " * 20)) for k in range(12)]
    rows += [(300, "http://a.example/x", "<body><p>Our offer 1</p></body>"), (301, None, None)]
    rows += [(200 + k, "http://c.example/x", f"<body><div>{'Only this. ' * 9}</div><p>{k}</p></body>") for k in range(6)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.extract(df).collect()}
    assert all(got[k] == f"a longer body of number {k}" for k in range(48))
    assert all("copied body" in got[100 + k] for k in range(12))
    assert all(got[200 + k] == f"{k}" for k in range(6))
    assert got[300] == "Our offer 1" and got[301] == ""


@pytest.mark.parametrize("broadcast", [200_000, 4, 0])
def test_template_counts_equal_brute_force(spark, monkeypatch, broadcast):
    """Counts by host, and what they delete, against loops over pages, subtrees and blocks."""
    monkeypatch.setattr(html, "BROADCAST_ROWS", broadcast)
    rng = random.Random(31)
    pool = [f"<div class=x{k}><p>{text(rng, 4)}</p>{'<p>more</p>' if k % 2 else ''}</div>" for k in range(8)]
    bodies = [text(rng, rng.randint(3, 30)) for _ in range(12)]
    rows = []
    for k in range(90):
        parts = [rng.choice(pool) for _ in range(rng.randint(0, 3))] + [f"<p>{rng.choice(bodies)}</p>"] * rng.randint(0, 2) + ["<section>" + rng.choice(pool) + "</section>"]
        rng.shuffle(parts)
        whole = "".join(parts)
        rows.append((k, f"http://h{k % 3 if k % 2 else 0}.example/{k}", f"<main>{whole}</main>" if k % 4 == 0 else f"<body>{whole}</body>"))
    parsed = [(i, u.split("/")[2], *html.article(h)[1:]) for i, u, h in rows]
    pages = {}
    for _, host, blocks, marks in parsed:
        for h, a, z in marks:
            outside = [b for k, b in enumerate(blocks) if not a <= k < z]
            if outside:
                pages.setdefault((host, h), set()).add(max(outside, key=len))
    want = {}
    for i, host, blocks, marks in parsed:
        gone = {k for h, a, z in marks if len(pages.get((host, h), ())) >= html.MIN_PAGES for k in range(a, z)}
        left = [b for k, b in enumerate(blocks) if k not in gone]
        want[i] = " ".join(left) if left or not blocks else max(blocks, key=len)
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == want and sum(len(p) >= html.MIN_PAGES for p in pages.values()) > 5


def test_only_real_attributes_drop_text():
    kept = """<article style="overflow:hidden" data-role=banner data-id='nav'><p title="The hidden cost">One <a href="/hidden-valley">two</a> <a href=/x/hidden title=it's>three</a></p><p data-hidden title="no end hidden>four</p></article>"""
    assert html.article(kept)[0] == "One two three four"
    gone = """<article><p>One</p><p hidden>a</p><p title="x"hidden>b</p><p HIDDEN=''>c</p><p aria-hidden = "true">d</p><div role='banner'>e</div><div data-x="y" class=nav>f</div></article>"""
    assert html.article(gone)[0] == "One"
    assert html.article('<div data-role="main"><p>in</p></div><p>out</p>')[0] is None
    assert html.article('<div role="main"><p>in</p></div><p>out</p>')[0] == "in"


# warc ------------------------------------------------------------------------------------------------------------------


def test_archives_round_trip(spark):
    body = "<p>" + "é" * 100
    rows = [(5, "http://b.org/", body), (3, "http://a.org/x", body), (9, "http://a.org/x", body), (4, "http://a.org/ü?q= 1", "short"), (6, "", "short"), (7, None, None), (8, "http://c.org", ""), (10, "http://a.org/x", "z" * 300_000), (3, "http://a.org/x", body)]
    df = spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows], "page_id bigint, url string, html string, digest string, first string")
    got = warc.archived(df).collect()
    assert len(got) == len(rows)
    for r in got:
        h = next(h for i, _, h in rows if i == r["page_id"])
        data = (h or "").encode()
        assert r["payload_bytes"] == len(data) and r["payload_digest"] == hashlib.sha256(data).hexdigest()
        again = r["page_id"] in (5, 9)
        assert (r["record_type"], r["refers_to"]) == (("revisit", 3) if again else ("response", None))
    keys = {i: warc.url_key(u) for i, u, _ in rows}
    ordered = [keys[r["page_id"]] for r in sorted(got, key=lambda r: r["position"])]
    assert ordered == sorted(ordered)
    assert warc.archived(df.limit(0)).count() == 0


@pytest.mark.parametrize("broadcast", [200_000, 1, 2])
def test_common_payloads_are_revisits(spark, monkeypatch, broadcast):
    """Whatever share of the recurring payloads is broadcast, and over several files."""
    monkeypatch.setattr(warc, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(warc, "RUN_BYTES", 300)
    rows = [(k, f"http://h/{k}", f"{k % 7}" * 150 if k % 3 else "often " * 40) for k in range(60)] + [(100, None, None), (101, "x", "short"), (102, "x", "short"), (None, "x", "often " * 40)]
    got = {r["page_id"]: r for r in warc.archived(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert len(got) == len(rows) and sorted(r["position"] for r in got.values()) == sorted({r["position"] for r in got.values()})
    first = {}
    for k, _, h in rows[:60]:
        first.setdefault(h, k)
    for k, _, h in rows:
        data = (h or "").encode()
        assert got[k]["payload_bytes"] == len(data) and got[k]["payload_digest"] == hashlib.sha256(data).hexdigest()
        want = first[h] if len(data) >= 100 and first[h] != k else None
        assert got[k]["refers_to"] == want and got[k]["record_type"] == ("response" if want is None else "revisit")


@pytest.mark.parametrize("rows", [100, 2, 1, 0])
def test_joins_with_hot_keys(spark, rows):
    left = [(k % 5 if k % 2 else 9, k) for k in range(40)] + [(None, 99)]
    counts = Counter(k for k, _ in left if k is not None and k != 3)
    right = spark.createDataFrame([(k, n, f"v{k}") for k, n in counts.items()], "k bigint, n bigint, v string")
    got = C.left_join_with_hot(spark.createDataFrame(left, "k bigint, x bigint"), right, ["k"], "n", rows or 1)
    assert got.columns == ["k", "x", "v"]
    assert Counter(map(tuple, got.collect())) == Counter((k, x, f"v{k}" if k in counts else None) for k, x in left)


def test_loser_tree_merges_in_order():
    rng = random.Random(0)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(rng.randint(0, 50) for _ in range(rng.randint(0, 40))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_members_and_keys():
    raw = b"".join(gzip.compress(x) for x in (b"a", b"", b"c" * 10**6))
    assert [x for _, x in warc.members(raw)] == [b"a", b"", b"c" * 10**6]
    assert warc.url_key("https://User@Www.Example.com:80/Path?Q#f") == "com,example,www)/path?q" and warc.url_key(None) == ""


# classifiers -----------------------------------------------------------------------------------------------------------


def test_trees_equal_a_walk_of_each_row():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    model = quality.fit_trees(x, y, trees=20, depth=3)
    p = quality.scored(x, model)
    assert ((p > 0.5) == y).mean() > 0.95
    for k in range(0, 600, 37):
        margin = model.base
        for f, t, leaf in zip(model.feature, model.threshold, model.leaf):
            node = 0
            while node < 7:
                node = 2 * node + 1 + (x[k, f[node]] > t[node])
            margin += leaf[node - 7]
        assert math.isclose(p[k], 1 / (1 + math.exp(-margin)))
    assert quality.scored(x[:2], quality.fit_trees(x, np.ones(600)))[0] > 0.99
    assert quality.scored(x[:2], quality.fit_trees(x[:0], y[:0])).tolist() == [0.5, 0.5]


def labelled(spark, rng, n, good, bad):
    rows = [(k, good(rng) if k % 3 else bad(rng), int(k % 3 > 0)) for k in range(n)]
    df = docs(spark, [(i, t) for i, t, _ in rows] + ODD)
    labels = spark.createDataFrame([(i, y, 1 - y, "x") for i, _, y in rows] + [(None, 1, 1, "x"), (10**6, 1, None, "x"), (3, None, None, "x"), (5, rows[5][2], 1 - rows[5][2], "x")], "doc_id bigint, quality int, toxic int, text string")
    return df.where("doc_id is null or doc_id > 8 or doc_id < 100"), labels, {i: y for i, _, y in rows if i > 8}


def test_statistics_and_grammar_of_very_long_texts(spark):
    """Scored whole: what stands at the end of a long text counts, and names that clash do no harm."""
    df = spark.createDataFrame([(1, "word " * 400_000 + "!!! $$$ 777", "x", "y"), (2, "word " * 400_000, "x", "y"), (3, None, "x", "y")], "doc_id bigint, text string, body string, __text string")
    x = quality.statistics(df.first()["text"])
    assert x[0] == np.log1p(5 * 400_000 + 11) and (x != quality.statistics("word " * 400_000)).any()
    got = quality.score(df, quality.fit_trees(np.zeros((0, quality.FEATURES)), np.zeros(0)))
    assert {r["score"] for r in got.collect()} == {0.5} and got.columns == ["doc_id", "text", "body", "__text", "score", "predicted"]
    grammar = toxicity.Grammar({}, {"fool": 5.0}, toxicity.prior_weights())
    long = df.select("doc_id", "body", "__text", F.when(F.col("doc_id") == 1, F.concat("text", F.lit(". you fool"))).otherwise(F.col("text")).alias("text"))
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(long, grammar).collect()}
    assert scores[1] > scores[2] == scores[3]


def test_clauses_equal_brute_force():
    """The composed machine against loops over the tokens of a clause."""
    g = toxicity.Grammar({"grump": 5.0}, {"fool": 4.0}, toxicity.prior_weights())
    m, rng = toxicity.Machine(g), random.Random(33)
    vocabulary = ["you", "not", "said", "fool", "grumpy", "kill", "the", "sky", "is"]
    for _ in range(400):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(1, 12))]
        want = []
        for k, w in enumerate(words):
            if w in ("fool", "grumpy", "kill"):
                kind = toxicity.THREATEN if w == "kill" else toxicity.INSULT
                negated = "not" in words[max(0, k - toxicity.SCOPE - 1) : k]
                want.append((toxicity.PATTERNS[kind, "you" in words, negated, "said" in words[:k]], {"fool": 4.0, "grumpy": 5.0, "kill": 3.0}[w]))
        assert m.clause(" ".join(words)) == want


def test_one_text_of_a_labelled_id(spark):
    df = spark.createDataFrame([(k % 6 + 1, f"text {k}") for k in range(60)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 7)], "doc_id bigint, quality int")
    got = quality.labelled_sample(df, labels, "quality", 100).collect()
    assert sorted(r["doc_id"] for r in got) == [k for k in range(1, 7) if zlib.crc32(str(k).encode()) % 5]
    assert quality.labelled_sample(df, labels, "quality", 2).count() == 2


def test_quality_on_held_out_documents(spark):
    df, labels, truth = labelled(spark, random.Random(4), 300, lambda r: text(r, 60), lambda r: " ".join([r.choice(WORDS)] * 50))
    model = quality.fit(df, labels)
    got = [r for r in quality.score(df, model).collect()]
    assert len(got) == df.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["doc_id"] in truth and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert held and all(r["predicted"] == truth[r["doc_id"]] for r in held)
    assert {r["score"] for r in quality.score(df, quality.fit(df, labels.limit(0))).collect()} == {0.5}
    assert quality.score(df.limit(0), model).count() == 0


def insulting(r):
    w = text(r, 50).split()
    for k in (5, 20, 35):
        w[k] = r.choice(["fluxo", "dumbo", "grumplet", "grumpling", "grumpish"])
    return " ".join(w[:25]) + ". " + " ".join(w[25:])


def test_toxicity_on_held_out_documents(spark):
    df, labels, truth = labelled(spark, random.Random(6), 300, lambda r: text(r, 60), insulting)
    grammar = toxicity.fit(df, labels)
    assert "dumbo" in grammar.words and any("grump".startswith(s) or s.startswith("grump") for s in grammar.stems)
    got = toxicity.score(df, grammar).collect()
    held = [r for r in got if r["doc_id"] in truth and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert held and all(r["predicted"] == 1 - truth[r["doc_id"]] for r in held) and all(0 <= r["score"] <= 1 for r in got)
    bare = toxicity.fit(df, labels.limit(0))
    assert not bare.stems and not bare.words and {r["predicted"] for r in toxicity.score(df, bare).collect()} == {0}
    assert toxicity.score(df.limit(0), grammar).count() == 0


def test_the_grammar_reads_clauses():
    g = toxicity.Grammar({"grump": 5.0}, {"fool": 5.0}, toxicity.prior_weights())
    m = toxicity.Machine(g)
    name = {v: k for k, v in toxicity.PATTERNS.items()}

    def found(t):
        return [name[p] for p, _ in m.matches(t)]

    assert found("You fool. He is nice") == [(toxicity.INSULT, True, False, False)]
    assert found("not a fool; a GRUMPLET") == [(toxicity.INSULT, False, True, False), (toxicity.INSULT, False, False, False)]
    assert found("he said they are fools? no: fool") == [(toxicity.INSULT, False, False, False)]
    assert found("he said they are no fool") == [(toxicity.INSULT, True, True, True)]
    assert found("I will kill you") == [(toxicity.THREATEN, True, False, False)]
    assert found("foolish befool ungrump") == [] and found(None) == found("") == []
    w = toxicity.prior_weights()
    score = lambda t: m.features(t) @ w[:-1] + w[-1]
    assert score("you fool") > score("she said you fool") > score("nothing here") and score("you fool") > score("you are not a fool")


# language model --------------------------------------------------------------------------------------------------------


def scored_rows(spark, rows):
    df = docs(spark, rows)
    held = C.crc_mod(F.col("doc_id"), 7) == 2
    counts = lmscore.count(df, ~held)
    return lmscore.score(df, held, counts, lmscore.fit(counts)).collect()


def test_base_scores_equal_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    rows = [*ODD, *LONG, *((100 + k, text(rng, rng.randint(0, 120)) + " " + str(rng.random())) for k in range(80)), (300, "a \0 b \0\0 \0"), (302, "\0")]
    for head in (250_000, 10):
        monkeypatch.setattr(lmscore, "HEAD", head)
        got = scored_rows(spark, rows)
        assert len(got) == len(rows)
        held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
        words = lambda t: [*(t or "").encode().lower().split(), None]
        counts = Counter(w for i, t in rows if i is not None and not held(i) for w in words(t))
        total, distinct = sum(counts.values()), len(counts)
        want = Counter()
        for i, t in rows:
            own = words(t)
            want[i, held(i), len(own), sum(counts[w] > 0 for w in own), round(sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in own), 6)] += 1
        assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
        assert {r["train_tokens"] for r in got} == {total} and all(r["score"] < 0 and r["bits_per_byte"] > 0 for r in got)


def test_language_model_beats_the_base_and_needs_no_rows(spark):
    rng = random.Random(9)
    rows = [(k, tongue(rng, "aa" if k % 2 else "bb", 200)) for k in range(200)]
    got = [r for r in scored_rows(spark, rows) if r["held_out"]]
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)
    assert scored_rows(spark, []) == []
    alone = scored_rows(spark, [(next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2), "a b")])
    assert alone[0]["n_known"] == 0 and alone[0]["base_score"] == 0


def test_every_word_of_training_has_its_share(spark, monkeypatch):
    """Scores don't depend on how many words are broadcast."""
    rng = random.Random(12)
    rows = [(k, text(rng, 60) + f" once{k} twice{k % 40}") for k in range(80)] + [(900 + k, f"twice{k} " * 3) for k in range(30)]
    got = []
    for head in (250_000, 10, 0):
        monkeypatch.setattr(lmscore, "HEAD", head)
        got.append({r["doc_id"]: r["score"] for r in scored_rows(spark, rows)})
    assert all(math.isclose(got[0][k], g[k], rel_tol=1e-4) for g in got[1:] for k in got[0])


def test_mixer_learns_from_every_word_of_training(spark, monkeypatch):
    rng = random.Random(31)
    rows = [(k, text(rng, 40) + f" only{k}") for k in range(120)]
    seen, learned = [], lmscore.learned_mixer
    monkeypatch.setattr(lmscore, "learned_mixer", lambda r, *a: seen.extend(map(tuple, r.collect())) or learned(r, *a))
    df = docs(spark, rows)
    held = C.crc_mod(F.col("doc_id"), 7) == 2
    counts = lmscore.count(df, ~held)
    lmscore.fit(counts)
    every = [[*t.encode().lower().split(), lmscore.END] for k, t in rows if zlib.crc32(str(k).encode()) % 7 != 2]
    words = Counter(w for own in every for w in own[:-1])
    got = Counter()
    for kind, key, _, n in seen:
        if kind == 0:
            got[bytes(key)] += n
    assert got == words
    assert sum(n for kind, _, _, n in seen if kind == 1) == sum(map(len, every))


@pytest.mark.parametrize("size", [5, 1500])
def test_clusters_are_found_over_all_texts(spark, monkeypatch, size):
    """As plain k-means from each of the random starts, of which the better half goes on every HALVED rounds."""
    rng = random.Random(32)
    rows = [(k, tongue(rng, ("aa", "bb")[k % 2], 8 + k % 5) if k % 9 else "") for k in range(size)] + [(size + k, "the same copy of one") for k in range(200)]
    pairs = lmscore.byte_pairs([t for _, t in rows])
    pairs = pairs[pairs.any(axis=1)].astype(np.int64)
    unit = lambda x: (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    distinct = spark.createDataFrame([(bytes(p.astype(np.uint8)),) for p in np.unique(pairs, axis=0)], "p binary").orderBy(F.xxhash64("p"), "p").collect()
    first = unit(np.array([list(r["p"]) for r in distinct[: lmscore.STARTS * lmscore.CLUSTERS]], float))
    if len(first) < lmscore.STARTS * lmscore.CLUSTERS:
        starts = [first[np.random.default_rng(k).permutation(len(first))[: lmscore.CLUSTERS]] for k in range(lmscore.STARTS)]
    else:
        starts = [first[k * lmscore.CLUSTERS : (k + 1) * lmscore.CLUSTERS] for k in range(lmscore.STARTS)]
    for done in range(1, lmscore.ROUNDS + 1):
        worth, after = [], []
        for centres in starts:
            dots = pairs.astype(np.float32) @ centres.T
            of = dots.argmax(axis=1)
            sums = [pairs[of == k].sum(axis=0) for k in range(len(centres))]
            after.append(np.array([unit(t[None].astype(float))[0] if t.any() else c for t, c in zip(sums, centres)]))
            worth.append(dots.max(axis=1).sum())
        same = all(np.array_equal(a, b) for a, b in zip(after, starts))
        starts = after
        if same or done % lmscore.HALVED == 0:
            best = sorted(np.argsort(-np.array(worth), kind="stable")[: 1 if same else max(1, len(starts) // 2)])
            starts = [starts[k] for k in best]
        if same:
            break
    got = lmscore.clustered(docs(spark, rows))
    assert got.shape == starts[0].shape and np.allclose(got, starts[0], atol=1e-3)


def slow_contexts(word, ahead, cluster):
    """The contexts of a word's bytes and its blank, named in plain words."""
    spelling, out = [*word, 32], []
    for k in range(len(spelling)):
        back = [spelling[k - j] if k >= j else 32 for j in range(1, 6)]
        cross = (ahead,) if k == 0 else (ahead, spelling[0]) if k == 1 else (spelling[0], spelling[1], back[0])
        out.append([(cluster, *back[:2]), (cluster, *back[:3]), (cluster, *back), (cluster, bytes(spelling[:k])), (cluster, min(k, 2), cross)])
    return spelling, out


def test_predictions_and_mixing_equal_brute_force():
    rng = random.Random(17)
    words = sorted({rng.choice(WORDS).encode() + (rng.choice(WORDS).encode() if rng.random() < 0.5 else b"") for _ in range(40)} | {"ñü".encode(), b"a", lmscore.END})
    cluster, n = np.array([k % 3 for k in range(len(words))]), np.array([1.0 + k * k % 150 for k in range(len(words))])
    data, early, whose = lmscore._spelled(words)
    letters = np.bincount(data, n[whose], 256)
    code = lmscore.huffman(letters)
    lengths = np.array([code.length[b] for b in range(256)])
    assert math.isclose(sum(2.0 ** -lengths), 1) and lengths[ord("a")] <= lengths[ord("Q")]
    counts = np.zeros((lmscore._OFFSETS[-1], 2), np.float32)
    lmscore._counted(counts, data, cluster[whose], n[whose], np.where(early, 0, n[whose]), code, range(lmscore.INPUTS))
    ones, zeros = (lmscore.packed(counts[:, k]).astype(np.uint16) for k in (1, 0))
    tables = lmscore.Tables(code, zeros | ones << np.uint16(8))
    seen, met = Counter(), Counter()
    for word, c, amount in zip(words, cluster, n):
        spelling, contexts = slow_contexts(word, None, c)
        for k, (byte, own) in enumerate(zip(spelling, contexts)):
            for node, bit in zip(code.node[byte][: code.length[byte]], code.bit[byte]):
                for p, context in enumerate(own):
                    if p != lmscore.ACROSS or k >= 2:
                        seen[p, context, int(node), int(bit)] += amount
    clipped = lambda x: lmscore.UNPACKED[int(lmscore.packed(np.array([float(x)]))[0])]
    weights, refine = np.random.default_rng(3).normal(size=(lmscore.GATES, lmscore.INPUTS)).astype(np.float32), np.random.default_rng(4).normal(size=(lmscore.GATES, lmscore.BUCKETS)).astype(np.float32)
    for left_out in (False, True):
        owner, sign, x, gate = lmscore.predictions(data, early, cluster[whose], tables, only=~early, left_out=left_out)
        logit, _ = lmscore.mixed_logits(x, gate, weights, refine)
        at, same = 0, 0
        for word, c in zip(words, cluster):
            spelling, contexts = slow_contexts(word, None, c)
            for k, (byte, own) in enumerate(zip(spelling, contexts)):
                if k < 2:
                    continue
                for node, bit in zip(code.node[byte][: code.length[byte]], code.bit[byte]):
                    sides = [[max(0.0, clipped(seen[p, context, int(node), side]) - (left_out and side == bit)) for side in (0, 1)] for p, context in enumerate(own)]
                    want = [math.log((o + 0.05) / (z + 0.05)) if z + o else 0.0 for z, o in sides]
                    level = sum(sum(sides[lmscore.SO_FAR]) >= limit for limit in lmscore.LEVELS)
                    dot = sum(weights[level, p] * want[p] for p in range(lmscore.INPUTS))
                    bucket = int(min(lmscore.BUCKETS - 1, max(0, dot * 1.5 + lmscore.BUCKETS // 2)))
                    same += np.allclose(x[:, at], want, atol=1e-4) and gate[at] == level and sign[at] == 2 * bit - 1 and abs(logit[at] - dot - refine[level, bucket]) < 1e-3
                    met[left_out] += 1
                    at += 1
        assert at == len(sign) and same >= 0.99 * at  # but for slots that two contexts share


def test_mixer_learns_and_does_not_depend_on_the_order_of_rows(spark):
    rng = random.Random(19)
    words = sorted({"".join(rng.choice(SYLLABLES["aa"]) for _ in range(rng.randint(1, 4))).encode() for _ in range(400)})
    rows = [(0, w, 0, rng.randint(1, 30)) for w in words]
    data, _, whose = lmscore._spelled(words)
    n = np.array([r[3] for r in rows], float)
    code = lmscore.huffman(np.bincount(data, n[whose], 256))
    counts = np.zeros((lmscore._OFFSETS[-1], 2), np.float32)
    lmscore._counted(counts, data, np.zeros(len(data), int), n[whose], n[whose] * 0, code, range(lmscore.ACROSS))
    tables = lmscore.Tables(code, lmscore.packed(counts[:, 0]).astype(np.uint16) | lmscore.packed(counts[:, 1]).astype(np.uint16) << np.uint16(8))
    got = []
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "kind int, key binary, cluster int, n bigint").repartition(3)
        got.append(lmscore.learned_mixer(df, tables, 2))
    assert all((a == b).all() for a, b in zip(*got))
    cost = lambda mixer: -lmscore.spelt(words, np.zeros(len(words), int), tables, *mixer) @ n
    assert cost(got[0]) < cost(lmscore.neutral())
    empty = lmscore.learned_mixer(df.limit(0), tables, 2)
    assert all((a == b).all() for a, b in zip(empty, lmscore.neutral()))


def told(texts):
    split = lmscore.tokens(texts)
    return lmscore.phrases(lmscore.hashes(split), np.array([len(own) - 1 for own in split], np.int64))


def cut(t):
    keys, stops, many = told([t])
    assert many.tolist() == [len(keys)] == [len(stops)]
    return keys, stops


def test_phrases_are_cut_alike_wherever_they_stand():
    rng = random.Random(20)
    common, texts = text(rng, 300), [text(rng, rng.randint(0, 90)) for _ in range(6)]
    keys = []
    for t in texts:
        whole = (t + " " + common).upper() if t.startswith("the") else t + " " + common
        own, stops = cut(whole)
        assert len(own) == len(stops) and stops[-1] == len(whole.split()) + 1 and (np.diff(stops) > 0).all()
        keys.append({tuple(k) for k in own.tolist()})
    shared = set.intersection(*keys)
    assert len(shared) >= len(cut(common)[0]) - 3 > 5
    odd = [None, "", " \n", "one", "a b c", "word " * 5000, *texts, "", "a b c d"]
    whole, stops, many = told(odd)
    for t, n, a in zip(odd, many, np.cumsum(many) - many):
        own, own_stops = cut(t)
        assert own_stops[-1] == len((t or "").split()) + 1 and (own == whole[a : a + n]).all() and (own_stops == stops[a : a + n]).all()
    assert (cut("a b c")[0] != cut("a b d")[0]).any() and (cut("A b  c\n")[0] == cut("a b c")[0]).all()
    assert len(told([])[0]) == 0


def test_scores_equal_brute_force(spark):
    """The whole model, from its tables, against loops over texts, words and phrases."""
    rng = random.Random(23)
    twin = text(rng, 120)
    rows = [(k, text(rng, rng.randint(0, 60)) + f" only{k} pair{k // 2}") for k in range(60)] + [(100, twin), (101, twin), (102, twin + " " + twin), (103, None), (104, "\0 x"), (105, text(rng, 40) + " unseen words here")]
    df = docs(spark, rows)
    held = C.crc_mod(F.col("doc_id"), 7) == 2
    counts = lmscore.count(df, ~held)
    model = lmscore.fit(counts)
    got = {r["doc_id"]: r for r in lmscore.score(df, held, counts, model).collect()}
    out = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    of = {i: int(lmscore.nearest(lmscore.byte_pairs([t]), model.centres)[0]) for i, t in rows}
    words = {i: lmscore.tokens([t])[0] for i, t in rows}
    total, by_cluster, phrase, ahead = Counter(), Counter(), Counter(), Counter()
    for i, t in rows:
        if not out(i):
            total.update(words[i])
            by_cluster.update((w, of[i]) for w in words[i][:-1])
            for k, p in cut(t)[0].tolist():
                phrase[k, p] += 1
                ahead[k] += 1
    sums = np.array([sum(n for (w, c), n in by_cluster.items() if c == k) for k in range(len(model.centres))], float)
    size, everything = sums * (1 + counts.texts / counts.tokens) + lmscore.SMOOTH, counts.tokens
    assert math.isclose(model.whole, 1 - sum(n == 1 for w, n in total.items() if w != lmscore.END) / everything)
    for i, t in rows:
        c, own = of[i], words[i]
        spelt = lmscore.spelt(own, np.full(len(own), c), model.tables, model.weights, model.refine)
        spelt = spelt + lmscore.Speller(model).starts(lmscore.neighbours([own]), np.full(len(own), c))
        assert (lmscore.Cut([t]).neighbours() == lmscore.neighbours([own])).all()
        whole = [((by_cluster[w, c] + lmscore.SMOOTH * total[w] / everything) if w != lmscore.END else (sums[c] + lmscore.SMOOTH) * counts.texts / everything) / size[c] for w in own]
        mixture = [math.log(model.whole * p + (1 - model.whole) * math.exp(b)) for p, b in zip(whole, spelt)]
        keys, stops = cut(t)
        mine = Counter(map(tuple, keys.tolist())) if not out(i) else Counter()
        before = Counter(keys[:, 0].tolist()) if not out(i) else Counter()
        state, score, begin = list(map(math.log, lmscore.EXPERTS)), -math.log(lmscore.CLUSTERS), 0
        for (k, p), stop in zip(keys.tolist(), stops):
            n = phrase[k, p] - mine[k, p]
            logs = [sum(mixture[begin:stop]), sum(spelt[begin:stop]), math.log(n / (ahead[k] - before[k] + 1)) if n > 0 else -math.inf]
            begin, top = stop, max(state)
            share = [math.exp(s - top) for s in state]
            share = [x / sum(share) for x in share]
            own_logs = [a + math.log(x) for a, x in zip(logs, share)]
            both = max(own_logs) + math.log(sum(math.exp(x - max(own_logs)) for x in own_logs))
            score += both
            state = [min(6, max(-6, math.log(x) + lmscore.GATE_RATE * (math.exp(a - both) - x))) for x, a in zip(share, own_logs)]
        assert math.isclose(got[i]["score"], score / math.log(10), rel_tol=1e-4), i
    alone, both = (got[i]["bits_per_byte"] for i in (0 if not out(0) else 1, 100))
    assert both < 0.3 * alone or out(100)


def test_words_are_cut_and_looked_up():
    texts = ["The quick\tBrown fox", None, "", " a\n", "ñÜ x\0 \0", "the"]
    cut, split = lmscore.Cut(texts), lmscore.tokens(texts)
    assert [cut.word(k) for k in range(len(cut.text))] == [w for own in split for w in own[:-1]]
    assert cut.lengths.tolist() == list(map(len, split)) and (cut.hashes == lmscore.hashes(split)).all()
    assert (cut.neighbours() == lmscore.neighbours(split)).all()
    assert cut.spread(cut.text, -1, int).tolist() == [x for k, own in enumerate(split) for x in [k] * (len(own) - 1) + [-1]]
    for none in ([], [None], ["", " "]):
        assert len(lmscore.Cut(none).neighbours()) == len(none)
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 2**64, 5000, dtype=np.uint64))
    keys[:200] = keys[:200] >> np.uint64(40)  # that all want the same slots
    keys = np.unique(keys)
    found = lmscore.Frequent(keys)
    assert (found(keys) == np.arange(len(keys))).all() and (found(rng.integers(0, 2**64, 5000, dtype=np.uint64)) == -1).all()
    assert (lmscore.Frequent(keys[:0])(keys) == -1).all()


def test_gate_follows_the_better_expert():
    good, bad, none = np.full((6, 1), -1.0), np.full((6, 1), -30.0), np.full((6, 1), -np.inf)
    first = lmscore.gated(np.hstack((bad, none, good)), np.array([6]))[0]
    assert -6 + 6 * math.log(lmscore.EXPERTS[2]) < first < -6
    two = lmscore.gated(np.vstack((np.hstack((bad, none, good)), np.hstack((good, bad, none))[:2])), np.array([6, 2]))
    assert math.isclose(two[0], first) and two[1] > -2.5
    assert lmscore.gated(np.empty((0, 3)), np.array([], int)).tolist() == []


# nearest neighbours ------------------------------------------------------------------------------------------------------


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 12)).astype(np.float32)
    x[100:180] = x[100]  # many copies
    rows = [(k, v.tolist(), 0) for k, v in enumerate(x)] + [(1000, None, 0), (1050, [0.0] * 12, 0), (1100, [float("nan")] * 12, 0), (1150, [float("inf")] + [1.0] * 11, 0), (1200, [1.0], 0), (None, [1.0] * 12, 0), (1250, [None] + [1.0] * 11, 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, rank int")
    got = ann.search(df, F.col("vec_id") % 20 == 0).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append(r)
    assert set(by) == {k for k in range(400) if k % 20 == 0}
    hits = 0
    for q, own in by.items():
        own.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == [1, 2, 3, 4, 5] and q not in {r["vec_id"] for r in own}
        c = ann.cosines(x[q].astype(float), x.astype(float))
        for r in own:
            assert r["score"] == c[r["vec_id"]]
        assert [(-r["score"], r["vec_id"]) for r in own] == sorted((-r["score"], r["vec_id"]) for r in own)
        c[q] = -9
        hits += len({r["vec_id"] for r in own} & set(np.lexsort((np.arange(400), -c))[:5].tolist()))
    assert hits >= 0.9 * 5 * len(by)
    assert [r["vec_id"] for r in sorted(by[120], key=lambda r: r["rank"])] == [100, 101, 102, 103, 104]


def exact_neighbours(rows, q, k):
    """Ids and cosines of the nearest other ids, an id's nearest vector counting."""
    own = [np.array(v, float) for i, v in rows if i == q]
    best = {}
    for i, v in rows:
        if i != q:
            for w in own:
                best[i] = max(best.get(i, -9), float(ann.cosines(w, np.array([v], float))[0]))
    return sorted(best, key=lambda i: (-best[i], i))[:k], best


def test_neighbours_where_ids_repeat(spark):
    """Ids that repeat don't push others out, and few lists don't hide any."""
    rows = [(0, [1.0, 0.1])] + [(1, [1.0, 0.0])] * 10 + [(k, [1.0, 0.0]) for k in range(2, 7)] + [(10, [0.0, 1.0]), (11, [-1.0, 0.2]), (12, [0.3, -1.0]), (13, [-1.0, -1.0])]
    for extra in ([], [(7, [math.cos(t), math.sin(t)]) for t in range(30)]):
        df = spark.createDataFrame(rows + extra, "vec_id bigint, embedding array<double>")
        for lists, probes in ((None, None), (4, 1)):
            got = sorted(map(tuple, ann.search(df, F.col("vec_id") % 50 == 0, k=12, lists=lists, probes=probes).select("rank", "vec_id", "score").collect()))
            ids, scores = exact_neighbours(rows + extra, 0, 12)
            assert [r[0] for r in got] == list(range(1, len(ids) + 1)) and [r[1] for r in got] == ids
            assert all(math.isclose(r[2], scores[r[1]]) for r in got)


def test_neighbours_in_blocks(spark, monkeypatch):
    """Long lists in several blocks, many queries in several parts."""
    monkeypatch.setattr(ann, "BLOCK", 30)
    monkeypatch.setattr(ann, "QUERIES", 5)
    monkeypatch.setattr(ann, "HELD", 3)
    rng = np.random.default_rng(4)
    rows = [(k, v.tolist()) for k, v in enumerate(rng.normal(size=(200, 6)))]
    got = ann.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") % 10 == 0, lists=3, probes=3, shortlist=200).collect()
    for q in range(0, 200, 10):
        assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == exact_neighbours(rows, q, 5)[0]


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01/embeddings.parquet"), reason="needs the driver's tables")
def test_recall_on_the_driver_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    lists = int(4 * len(rows) ** 0.5)
    got = ann.search(df, F.col("vec_id") % 50 == 0, probes=lists // 3).collect()
    hits = sum(len({r["vec_id"] for r in got if r["query_id"] == q} & set(exact_neighbours(rows, q, 5)[0])) for q, _ in rows if q % 50 == 0)
    assert hits >= 0.9 * len(got) and len(got) == 5 * sum(q % 50 == 0 for q, _ in rows)


def test_asymmetric_distances_follow_the_codes():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = ann.fit(x, 6, 4)
    x = x.astype(np.float32)
    near = ann.nearest(x, index.centroids, 2)
    assert (near[:, 0] == ((x[:, None] - index.centroids) ** 2).sum(axis=2).argmin(axis=1)).all() and (near[:, 0] != near[:, 1]).all()
    codes = ann.encode(x, near[:, 0], index)
    whole = ann.decoded(near[:, 0], codes, index)
    assert ((x - whole) ** 2).sum(axis=1).mean() < ((x - index.centroids[near[:, 0]]) ** 2).sum(axis=1).mean()
    dots = sum(t.T[:, codes[:, p]] for p, t in enumerate(ann.tables(x[:5], index))) + (x[:5] @ index.centroids.T)[:, near[:, 0]]
    assert np.allclose(dots, x[:5] @ whole.T, atol=1e-5)


def test_neighbours_of_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], "vec_id bigint, embedding array<float>")
    got = ann.search(df, F.col("vec_id") % 50 == 0).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(0, 1, 1)] and math.isclose(got[0]["score"], 0.5**0.5)
    assert ann.search(df.limit(0), F.lit(True)).count() == 0
