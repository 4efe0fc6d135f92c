"""Main text of web pages by removal of site templates.

Every page is parsed once. Elements that are furniture by their tag, role or class go, and if the page marks
its article, all outside it. On every page each element's subtree is hashed (tag, class, text and
children), Spark counts for each host on how many different pages a subtree stands, and those on
MIN_PAGES or more, the site's template, are deleted. Inside a marked article only boxes count and elements that carry a
class, id or role: its bare paragraphs, headings and list items are its text, however often a site repeats them. Pages are different by the
largest block outside the subtree, so a long notice counts on every page while what only copies of a page
share counts once, and copies keep their text. Where all would go, the largest block stays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: A subtree is template if it stands on so many different pages of a host, however large that is.
MIN_PAGES = 5
#: The template is broadcast up to this many subtrees; beyond it the most common ones are, and the others are joined by shuffle.
BROADCAST_ROWS = 200_000

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)(?:"|\Z)|'([^']*)(?:'|\Z)|([^\s"'>][^\s>]*)))?""")
TOLD = frozenset("class id role hidden aria-hidden".split())
SPLIT = re.compile(r"[^a-z]+")
BLANK = re.compile(r"\s+")
# fixed values: elements of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math select object video audio canvas".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
FURNITURE = frozenset("head nav footer aside form button menu dialog header".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th pre blockquote figcaption address".split())
CLOSES = {"p": frozenset(["p"]), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
BARRIER = frozenset("ul ol dl table article section main div body html nav aside footer header form blockquote td".split())
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert form".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer header masthead cookie cookies consent gdpr notice popup modal overlay newsletter subscribe signup login comment comments disqus reply replies share sharing social related recommended widget toolbar pagination pager".split()
)
OWN = frozenset("article post entry content story main body text".split())


def _told(attributes: str) -> dict[str, str]:
    """Values of the attributes that matter, in lower case; of one that repeats the first counts."""
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(attributes):
        if (name := m[1].lower()) in TOLD:
            out.setdefault(name, (m[2] or m[3] or m[4] or "").lower())
    return out


def _furniture(tag: str, told: dict[str, str], inside: bool) -> bool:
    if tag in FURNITURE and not (tag == "header" and inside):
        return True
    if "hidden" in told or told.get("aria-hidden") == "true" or told.get("role") in ROLES:
        return True
    for name in ("class", "id"):
        if name in told:
            words = {w for w in SPLIT.split(told[name]) if w}
            if words & NAMES and not (words & OWN and not words & {"comment", "comments", "ad", "ads", "advert", "sidebar", "footer", "nav", "menu"}):
                return True
    return False


class Page:
    """Blocks of text outside furniture, whether each is in the article, and the subtrees that hold them."""

    def __init__(self, html: str):
        self.blocks: list[str] = []
        self.own: list[bool] = []
        self.marks: list[tuple[int, int, int]] = []  # hash, first block, one after the last
        self.article = False
        self._text: list[str] = []
        self._stack: list[tuple[str, bool, bool, int, str, list[bytes]]] = []  # tag, dropped, in article, first block, attributes, parts
        self._parse(html)

    def _flush(self) -> None:
        if self._text:
            text = BLANK.sub(" ", unescape("".join(self._text))).strip()
            self._text.clear()
            if text:
                self.blocks.append(text)
                self.own.append(bool(self._stack) and self._stack[-1][2])
                if self._stack:
                    self._stack[-1][5].append(text.encode("utf-8", "surrogatepass"))

    def _close(self) -> None:
        tag, dropped, inside, first, attributes, parts = self._stack[-1]
        if tag not in INLINE:
            self._flush()
        self._stack.pop()
        if not dropped and parts:
            digest = xxhash.xxh3_64_digest(tag.encode() + b"\0" + attributes.encode("utf-8", "surrogatepass") + b"\0" + b"\1".join(parts))
            if tag in INLINE:
                if self._stack:
                    self._stack[-1][5].extend(parts)
                return
            if not (inside and tag in PROSE and not attributes):
                self.marks.append((int.from_bytes(digest, "little", signed=True), first, len(self.blocks)))
            if self._stack:
                self._stack[-1][5].append(digest)

    def _parse(self, html: str) -> None:
        at, stack = 0, self._stack
        while m := TOKEN.search(html, at):
            if m.start() > at and not (stack and stack[-1][1]):
                self._text.append(html[at : m.start()])
            at = m.end()
            tag = m[2] or m[5]
            if not tag:
                continue
            tag, closing, attributes = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
            if closing:
                depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
                if depth is not None:
                    while len(stack) > depth:
                        self._close()
                elif tag in ("p", "br"):
                    self._text.append(" ")
                continue
            if tag in RAW:
                if not attributes.endswith("/"):
                    end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
                    at = end.end() if end else len(html)
                continue
            if tag in VOID:
                if tag not in ("wbr", "img", "input"):
                    self._text.append(" ")
                if tag == "hr":
                    self._flush()
                continue
            closes = CLOSES.get(tag, frozenset()) | (frozenset(["p"]) if tag in ENDS_P else frozenset())
            if closes:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in closes:
                        while len(stack) > k:
                            self._close()
                        break
                    if stack[k][0] in BARRIER:
                        break
            if tag not in INLINE:
                self._flush()
            dropped, inside = (stack[-1][1], stack[-1][2]) if stack else (False, False)
            told = _told(attributes) if attributes else {}
            if not dropped and tag != "body" and tag != "html":
                dropped = _furniture(tag, told, inside)
            if not dropped and (tag in ("article", "main") or told.get("role", "").split()[:1] == ["main"]):
                inside = self.article = True
            if attributes.endswith("/") and tag not in INLINE:
                continue
            stack.append((tag, dropped, inside, len(self.blocks), " ".join(f"{k}={v}" for k, v in sorted(told.items())), []))
        if at < len(html) and not (stack and stack[-1][1]):
            rest = html[at:]
            self._text.append(rest[: rest.find("<")] if re.search(r"<[a-zA-Z/!][^>]*\Z", rest) else rest)
        while stack:
            self._close()
        self._flush()


def article(html: str | None) -> tuple[str | None, list[str], list[tuple[int, int, int]]]:
    """The text ahead of template removal if the page marks its article or holds nothing, otherwise None; the blocks
    (of a marked article only its own) and the subtrees (hash, first, end) that may be template."""
    page = Page(html or "")
    blocks, marks = page.blocks, page.marks
    if page.article:
        blocks = [b for b, own in zip(page.blocks, page.own) if own]
        place = [*accumulate(map(int, page.own), initial=0)]
        marks = [(h, place[a], place[z]) for h, a, z in marks if place[a] < place[z]]
    if not blocks:
        return "", [], []
    return " ".join(blocks) if page.article else None, blocks, marks


def _largest(blocks: list[str]) -> int:
    return max(range(len(blocks)), key=lambda k: (len(blocks[k]), -k))


def _beside(blocks: list[str], marks: list[tuple[int, int, int]]) -> list[int | None]:
    """For each subtree the hash of the largest block outside it; None if it holds all blocks."""
    order = [(-len(b), k) for k, b in enumerate(blocks)]
    before = [None, *accumulate(order, min)]
    after = [*accumulate(reversed(order), min)][::-1] + [None]
    digests: dict[int, int] = {}

    def digest(k: int) -> int:
        if k not in digests:
            digests[k] = int.from_bytes(xxhash.xxh3_64_digest(blocks[k].encode("utf-8", "surrogatepass")), "little", signed=True)
        return digests[k]

    beside = (min(filter(None, (before[a], after[z])), default=None) for _, a, z in marks)
    return [digest(x[1]) if x else None for x in beside]


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 36
    mark = pa.struct([("hash", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("main", pa.int64())])
    for batch in batches:
        for begin in range(0, batch.num_rows, 500):
            part = batch.slice(begin, 500)
            found = [article(h) for h in C.texts(part, "html")]
            rows = range(row, row + len(found))
            row += len(found)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rows, pa.int64()),
                    part.column("page_id"),
                    part.column("url"),
                    pa.array([b for _, b, _ in found], pa.list_(pa.string())),
                    pa.array([[{"hash": h, "first": a, "last": z, "main": d} for (h, a, z), d in zip(m, _beside(b, m))] for _, b, m in found], pa.list_(mark)),
                    pa.array([_largest(b) if b else None for _, b, _ in found], pa.int32()),
                ],
                names=["row", "page_id", "url", "blocks", "marks", "largest"],
            )


def _without(template: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = frozenset()
        for batch in batches:
            marks = batch.column("marks")
            flat = marks.flatten()
            hashes, first, last = (flat.field(k).to_pylist() for k in ("hash", "first", "last"))
            ends = np.cumsum(pc.fill_null(pc.list_value_length(marks), 0).to_numpy(zero_copy_only=False)).tolist()
            texts, at = [], 0
            for host, blocks, largest, end in zip(batch.column("host").to_pylist(), batch.column("blocks").to_pylist(), batch.column("largest").to_pylist(), ends):
                own = template.value.get(host, none)
                gone = {b for k in range(at, end) if hashes[k] in own for b in range(first[k], last[k])}
                at = end
                if blocks and len(gone) == len(blocks):
                    texts.append(blocks[largest])
                else:
                    texts.append(" ".join(b for k, b in enumerate(blocks) if k not in gone))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return run


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row.

    Null and empty pages give an empty text; rows that repeat are extracted each; pages without a host
    (null or relative url) share one; an empty table gives no rows; other columns are ignored."""
    source = C.small_batches(pages).select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in source.schema}
    schema = f"row bigint, page_id {kinds['page_id']}, url {kinds['url']}, blocks array<string>, marks array<struct<hash:bigint,first:int,last:int,main:bigint>>, largest int"
    parsed = C.stored(source.mapInArrow(_parsed, schema))
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    parsed = parsed.withColumn("host", host)
    marks = parsed.select("row", "host", F.explode("marks").alias("m")).select("row", "host", "m.hash", "m.first", "m.last", "m.main")
    counts = marks.where("main is not null").groupBy("host", "hash", "main").agg(F.lit(1)).groupBy("host", "hash").agg(F.count("*").alias("n"))
    template = C.stored(counts.where(F.col("n") >= MIN_PAGES).select("host", "hash", F.col("n").alias("times"), F.lit(True).alias("recurs")))
    with_length = lambda df: df.withColumn("n_chars", F.char_length("text").cast("bigint"))
    if template.count() <= BROADCAST_ROWS:
        known = {r["host"]: frozenset(r["hashes"]) for r in template.groupBy("host").agg(F.collect_list("hash").alias("hashes")).collect()}
        kept = _without(pages.sparkSession.sparkContext.broadcast(known))
        return with_length(parsed.select("page_id", "url", "host", "blocks", "marks", "largest").mapInArrow(kept, f"page_id {kinds['page_id']}, url {kinds['url']}, text string"))
    gone = C.left_join_with_hot(marks.drop("main"), template, ["host", "hash"], "times", BROADCAST_ROWS).where("recurs").groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("gone"))
    left = F.expr("filter(blocks, (b, i) -> gone is null or not exists(gone, g -> g.first <= i and i < g.last))")
    text = F.expr("case when size(kept) = 0 and largest is not null then blocks[largest] else array_join(kept, ' ') end")
    return with_length(parsed.join(gone, "row", "left").withColumn("kept", left).select("page_id", "url", text.alias("text")))
