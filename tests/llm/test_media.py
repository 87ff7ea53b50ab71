"""Interleaved sequences, resolved from a store, against Python."""

import hashlib
import html.parser
import zlib

import numpy as np
from pyspark.sql import functions as F

from varidoc.llm import media


def expected(text):
    """The columns of op1 for one text, from their definition."""
    raw = (text or "").encode()
    payload = raw + bytes(-len(raw) % 64 if raw else 64)
    stored = b"P5\n64 %d\n255\n" % (len(payload) // 64) + payload
    x = np.frombuffer(payload, np.uint8).astype(int)
    quarters = ",".join(str(q.sum()) for q in np.array_split(x, 4))
    feature = f"{len(x) // 64}x64;sum={x.sum()};max={x.max()};zeros={(x == 0).sum()};quarters={quarters}"
    return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature


COLUMNS = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def test_op1_on_the_table(spark, sf):
    got = {r["doc_id"]: r for r in media.op1_media(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        assert tuple(got[r["doc_id"]][c] for c in COLUMNS) == expected(r["text"])
        first, _, rest = (r["text"] or "").partition("\n")
        n = bool(first.strip()) + 1 + bool(rest.strip())
        assert got[r["doc_id"]]["n_items"] == n and got[r["doc_id"]]["position"] == int(bool(first.strip()))
        assert got[r["doc_id"]]["text_offset"] == (len(first) if first.strip() else 0) and got[r["doc_id"]]["caption"] == f"{len((r['text'] or '').encode())} bytes"


def test_odd_documents_come_back_whole(odd, empty):
    """Every row has its sequence, null and repeated ids too; texts and figures are in page order."""
    docs = odd.select("doc_id", "text")
    got = media.resolved(media.as_pages(docs), media.stored(docs), id_col="doc_id").collect()
    assert len(got) == odd.count()
    shown = []
    for r in got:
        assert [i["position"] for i in r["items"]] == [*range(len(r["items"]))]
        figure = [i for i in r["items"] if i["kind"] == "image"]
        assert len(figure) == 1 and figure[0]["media"]["payload_sha256"] == figure[0]["digest"]
        texts = [i for i in r["items"] if i["kind"] == "text"]
        assert all(i["media"] is None for i in texts)
        offset = 0
        for i in r["items"]:
            assert i["text_offset"] == offset and i["chars"] == len(i["text"] or "")
            offset += i["chars"]
        shown.append((str(r["doc_id"]), "".join(i["text"] for i in texts), figure[0]["media"]["payload_bytes"]))
    want = []
    for r in docs.collect():
        first, line, rest = (r["text"] or "").partition("\n")
        said = (first if first.strip() else "") + (line + rest if (line + rest).strip() else "")
        want.append((str(r["doc_id"]), said, expected(r["text"])[1]))
    assert sorted(shown) == sorted(want)
    none = media.resolved(media.as_pages(empty.select("doc_id", "text")), media.stored(docs), id_col="doc_id")
    assert none.count() == 0
    lost = media.resolved(media.as_pages(docs), media.stored(docs.limit(0)), id_col="doc_id", texts=False)
    assert lost.count() == odd.count() and lost.filter(F.exists("items", lambda x: x["media"].isNotNull() | x["text"].isNotNull())).count() == 0


def test_clashing_columns(spark, odd):
    docs = odd.select("doc_id", "text", F.lit(1).alias("page"), F.lit(2).alias("digest"), F.lit("x").alias("media"))
    pages = media.as_pages(docs).withColumn("page", F.lit(3)).withColumn("digest", F.lit("mine"))
    got = media.resolved(pages, media.stored(docs), id_col="doc_id", keep=["page", "digest"]).collect()
    assert len(got) == odd.count() and {(r["page"], r["digest"]) for r in got} == {(3, "mine")}


class _Texts(html.parser.HTMLParser):
    """The visible text of a page, without any notion of blocks."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.silent = [], 0

    def handle_starttag(self, tag, attrs):
        self.silent += tag in ("script", "style", "template")

    def handle_endtag(self, tag):
        self.silent -= tag in ("script", "style", "template")

    def handle_data(self, data):
        if not self.silent:
            self.out.append(data)


def test_pages(spark, sf):
    """No visible character of a page is lost but white space between blocks."""
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    parsed = {r["page_id"]: r["items"] for r in media.resolved(spark.read.parquet(f"{sf}/pages.parquet"), media.stored(spark.createDataFrame([], "text string"))).collect()}
    counts = {r["page_id"]: r for r in media.media_pages(spark, sf).collect()}
    assert {*parsed} == {*pages} == {*counts}
    for page, source in pages.items():
        p = _Texts()
        p.feed(source or "")
        p.close()
        texts = [i["text"] for i in parsed[page] if i["kind"] == "text"]
        assert "".join("".join(texts).split()) == "".join("".join(p.out).split())
        assert counts[page]["n_items"] == len(parsed[page]) and counts[page]["text_md5"] == hashlib.md5("\n".join(texts).encode()).hexdigest()
        assert counts[page]["kinds"] == " ".join(i["kind"] for i in parsed[page])
