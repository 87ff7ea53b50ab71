"""Interleaved document sequences: text and media in the order of an HTML page.

A page is parsed into an ordered array of items, each a text or a media reference with its digest, its
caption (figcaption, else alt text) and its place in the page's text. References are resolved by a join on
the digest with a media store and come back to their places in the array; a reference without a stored payload
keeps its place with null media. The store keeps 8-bit samples losslessly as binary greymaps (PGM), named by
the SHA-256 of the payload; a task stores a payload once, and every stored form is read back and measured.
What is joined is a row of measures for each digest, so a payload that a third of the documents share is
neither moved nor expanded, and Spark's skew join splits its references. Texts may stay behind as spans of the
page's text (offset and length), so that only a page's skeleton is moved.

Null and empty HTML give an empty sequence; equal rows give equal sequences, one for each row, whatever their
ids; unclosed tags close at the end; script and style content is no text. An empty text is stored as one unit
of zeros. Columns other than the page's id, those to keep and the HTML are not read.
"""

from __future__ import annotations

import hashlib
import html
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, in_parts, written

#: Samples in a row of a stored greymap, and so the unit of its payload.
WIDTH = 64
SCHEME = "sha256:"
ITEM = "struct<position: int, kind: string, text: string, digest: string, caption: string, text_offset: long, chars: long>"
#: Tags whose ends and beginnings part texts, and tags that refer to media.
BLOCKS = frozenset("p div li ul ol table tr td th h1 h2 h3 h4 h5 h6 br article section header footer nav aside figure figcaption blockquote pre main title body html head".split())
MEDIA = {"img": "image", "video": "video", "audio": "audio", "source": "source"}
SILENT = frozenset(["script", "style", "template"])


class _Sequence(HTMLParser):
    """Collects a page's items. A caption goes to the media item of its figure."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.caption: list[str] | None = None
        self.figure: list[int] = []  # items at which open figures began
        self.silent = self.passed = 0

    def flush(self) -> None:
        text = "".join(self.words)
        self.words = []
        if text.strip():
            self._add("text", text, None, None)
            self.passed += len(text)

    def _add(self, kind: str, text: str | None, digest: str | None, caption: str | None) -> None:
        self.items.append({"position": len(self.items), "kind": kind, "text": text, "digest": digest, "caption": caption, "text_offset": self.passed, "chars": len(text or "")})

    def handle_starttag(self, tag, attrs):
        if tag in SILENT:
            self.silent += 1
        if tag in BLOCKS or tag in MEDIA:
            self.flush()
        if tag == "figure":
            self.figure.append(len(self.items))
        elif tag == "figcaption":
            self.caption = []
        elif tag in MEDIA:
            given = dict(attrs)
            source = given.get("src") or ""
            if source or tag != "source":
                self._add(MEDIA[tag], None, source.removeprefix(SCHEME) if source.startswith(SCHEME) else source or None, given.get("alt"))

    def handle_endtag(self, tag):
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        if tag == "figcaption" and self.caption is not None:
            text, self.caption = "".join(self.caption).strip(), None
            for item in self.items[self.figure[-1] if self.figure else len(self.items) :]:
                if item["kind"] != "text":
                    item["caption"] = text
        elif tag == "figure" and self.figure:
            self.flush()
            self.figure.pop()
        elif tag in BLOCKS:
            self.flush()

    def handle_data(self, data):
        if self.caption is not None:
            self.caption.append(data)
        elif not self.silent:
            self.words.append(data)


def parse(page: str | None) -> list[dict]:
    parser = _Sequence()
    parser.feed(page or "")
    parser.close()
    parser.flush()
    return parser.items


def sequences(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] | list[str] = (), texts: bool = True) -> DataFrame:
    """id, the columns to keep, and items, in page order; without texts, these are null beside their spans."""
    kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string()), ("text_offset", pa.int64()), ("chars", pa.int64())]))
    fields = [id_col, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [parse(page) for page in batch.column(html_col).to_pylist()]
            if not texts:
                made = [[item | {"text": None} for item in items] for items in made]
            yield pa.RecordBatch.from_arrays([*[batch.column(f) for f in fields], pa.array(made, kind)], [*fields, "items"])

    schema = ", ".join([*[f"`{f}` {pages.schema[f].dataType.simpleString()}" for f in fields], f"items array<{ITEM}>"])
    return pages.select(*fields, html_col).mapInArrow(in_parts(run), schema)


def references(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """id, the columns to keep, and position, kind, caption, text_offset, digest of every media reference."""
    parsed = sequences(pages, id_col=id_col, html_col=html_col, keep=keep, texts=False)
    item = parsed.select(id_col, *keep, F.explode(F.filter("items", lambda x: x["kind"] != "text")).alias("item"))
    return item.select(id_col, *keep, *[F.col("item")[c].alias(c) for c in ("position", "kind", "caption", "text_offset", "digest")])


def resolve(refs: DataFrame, store: DataFrame) -> DataFrame:
    """refs with the measures of their payloads; null where the store does not have one."""
    return refs.join(measures(store), "digest", "left")


def resolved(pages: DataFrame, store: DataFrame, *, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] | list[str] = (), texts: bool = True) -> DataFrame:
    """sequences, each media item with the measures of its payload as media (null where the store has none):
    items are exploded, references are joined on their digest, and all come together again in page order."""
    page = fresh(pages, "page")
    numbered = pages.withColumn(page, F.monotonically_increasing_id())
    parsed = written(sequences(numbered, id_col=id_col, html_col=html_col, keep=[page, *keep], texts=texts), "media-pages")
    items = parsed.select(F.col(page).alias("page"), F.explode("items").alias("item"))
    found = resolve(items.filter("item.kind <> 'text'").withColumn("digest", F.col("item.digest")), store)
    media = F.when(F.col("payload_sha256").isNotNull(), F.struct(*[c for c in found.columns if c not in ("digest", "page", "item")]))
    found = found.select("page", F.col("item").withField("media", media).alias("item"))
    none = F.lit(None).cast(found.schema["item"].dataType["media"].dataType)
    every = items.filter("item.kind = 'text'").select("page", F.col("item").withField("media", none).alias("item")).unionByName(found)
    # position is the first field, so the sorted array is in page order
    whole = every.groupBy(F.col("page").alias(page)).agg(F.array_sort(F.collect_list("item")).alias("items"))
    none = F.array().cast(whole.schema["items"].dataType)
    return parsed.drop("items").join(whole, page, "left").select(id_col, *keep, F.coalesce("items", none).alias("items"))


def payload_of(text: str | None) -> bytes:
    """The UTF-8 bytes, filled up with zeros to a positive multiple of WIDTH."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(max(-len(raw) % WIDTH, WIDTH if not raw else 0))


def greymap(payload: bytes) -> bytes:
    """8-bit samples as a binary greymap of WIDTH columns."""
    return b"P5\n%d %d\n255\n" % (WIDTH, len(payload) // WIDTH) + payload


def samples(stored: bytes) -> bytes:
    """The samples of a binary greymap."""
    magic, size, depth, rest = stored.split(b"\n", 3)
    width, height = map(int, size.split())
    if magic != b"P5" or depth != b"255" or len(rest) != width * height:
        raise ValueError("not an 8-bit greymap")
    return rest


def measures(store: DataFrame) -> DataFrame:
    """For each stored digest: sizes, digests and features of the samples read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, stored in zip(batch.column("digest").to_pylist(), batch.column("media").to_pylist()):
                payload = samples(stored)
                sha = hashlib.sha256(payload).hexdigest()
                if sha != name:
                    raise ValueError(f"the stored form of {name} is damaged")
                x = np.frombuffer(payload, dtype=np.uint8)
                quarters = [int(q.sum(dtype=np.int64)) for q in np.array_split(x, 4)]
                feature = f"{len(x) // WIDTH}x{WIDTH};sum={int(x.sum(dtype=np.int64))};max={int(x.max())};zeros={int((x == 0).sum())};quarters={','.join(map(str, quarters))}"
                rows.append((name, len(payload), sha, zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature))
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    schema = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return store.mapInArrow(in_parts(run), schema).dropDuplicates(["digest"])


def stored(docs: DataFrame) -> DataFrame:
    """digest and media (the stored form) of the documents' payloads, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            names, forms = [], []
            for text in batch.column("text").to_pylist():
                payload = payload_of(text)
                sha = hashlib.sha256(payload)
                if sha.digest() not in seen:
                    seen.add(sha.digest())
                    names.append(sha.hexdigest())
                    forms.append(greymap(payload))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(forms, pa.binary())], ["digest", "media"])

    return written(docs.select("text").mapInArrow(in_parts(run), "digest string, media binary"), "media-store", compression="zstd")


def as_pages(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and html: each document as a page of its first line, its payload as a captioned figure,
    and the rest of its text."""

    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages, sizes = [], []
            for text in batch.column("text").to_pylist():
                payload, n = payload_of(text), len((text or "").encode("utf-8", "surrogatepass"))
                first, line, rest = (text or "").partition("\n")
                figure = f'<figure><img src="{SCHEME}{hashlib.sha256(payload).hexdigest()}" alt=""><figcaption>{n} bytes</figcaption></figure>'
                pages.append(f"<article><p>{html.escape(first)}</p>{figure}<p>{html.escape(line + rest)}</p></article>")
                sizes.append(n)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(pages, pa.string())], ["doc_id", "n_bytes", "html"])

    return docs.select("doc_id", "text").mapInArrow(in_parts(run), f"doc_id {id_type}, n_bytes long, html string")


def op1_media(spark, sf_dir: str) -> DataFrame:
    """Each document's page as a sequence whose figure is resolved from the store."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = resolved(as_pages(docs), stored(docs), id_col="doc_id", keep=["n_bytes"], texts=False)
    item = F.filter("items", lambda x: x["kind"] == "image")[0]
    got = got.select("doc_id", "n_bytes", item.alias("item"), F.size("items").alias("n_items"), F.aggregate("items", F.lit(0).cast("long"), lambda n, x: n + x["chars"]).alias("text_chars"))
    return got.select("doc_id", "n_bytes", "item.media.*", "item.position", "item.caption", "item.text_offset", "n_items", "text_chars")


def media_pages(spark, sf_dir: str) -> DataFrame:
    """The web pages as sequences of texts and media references: how many of each, and the order of kinds."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text")
    got = resolved(pages.select("page_id", "html"), stored(docs.limit(0)))
    text = F.array_join(F.transform(F.filter("items", lambda x: x["kind"] == "text"), lambda x: x["text"]), "\n")
    return got.select("page_id", F.size("items").alias("n_items"), F.size(F.filter("items", lambda x: x["kind"] != "text")).alias("n_media"),
                      F.array_join(F.transform("items", lambda x: x["kind"]), " ").alias("kinds"), F.md5(text.cast("binary")).alias("text_md5"))
