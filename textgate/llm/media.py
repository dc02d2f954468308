"""Interleaved document sequences: ordered text and media references parsed from HTML, with payloads resolved by digest.

read() turns each page into its sequence: text runs and media references with their digest and caption, in reading order;
parse() gives a row per element. Payloads are rows of a media table keyed by digest; described() reads them back where they are, and resolve()
joins what it finds to the references by digest: one stored payload serves all its uses, position and caption stay with the reference, and
payloads don't move. Samples are stored as binary portable pixmaps
(8-bit RGB, 64 samples wide: 192 bytes a row).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from .common import arrow_map, slices, written

ROW = 192
SCHEME = "sha256:"
#: References that are more than 1 / HOT of all are joined apart.
HOT = 1024
_SKIPPED = {"script", "style", "template", "noscript"}
_INLINE = {"a", "abbr", "b", "cite", "code", "em", "font", "i", "mark", "q", "s", "small", "span", "strong", "sub", "sup", "u"}


class _Reader(HTMLParser):
    """Collects (kind, text, ref, caption) in reading order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[list] = []
        self.run: list[str] = []
        self.skip, self.figure, self.caption = 0, [], None

    def flush(self) -> None:
        text = " ".join("".join(self.run).split())
        self.run = []
        if text:
            self.items.append(["text", text, None, None])

    def end_caption(self) -> None:
        """The caption goes to its figure's media; without any it is text. It ends with its figure if it is never closed."""
        if self.caption is not None:
            text = " ".join("".join(self.caption).split())
            self.caption = None
            media = self.figure[-1] if self.figure else []
            for item in media:
                item[3] = text
            if not media and text:
                self.items.append(["text", text, None, None])

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _SKIPPED:
            self.skip += 1
        elif tag in ("img", "video", "audio", "source", "embed"):
            at = dict(attrs)
            if not self.skip and at.get("src"):
                self.flush()
                self.items.append(["media", None, at["src"], at.get("alt")])
                if self.figure:
                    self.figure[-1].append(self.items[-1])
        elif tag == "figure":
            self.end_caption()
            self.flush()
            self.figure.append([])
        elif tag == "figcaption":
            self.end_caption()
            self.flush()
            self.caption = []
        elif tag not in _INLINE:
            self.flush()

    def handle_endtag(self, tag: str) -> None:
        if tag in _SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag == "figcaption":
            self.end_caption()
        elif tag == "figure":
            self.end_caption()
            self.flush()
            if self.figure:
                self.figure.pop()
        elif tag not in _INLINE:
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.skip:
            (self.run if self.caption is None else self.caption).append(data)


def read_html(html: str | None) -> list[tuple]:
    """(position, kind, text, ref, caption) of a page's elements; none for null or empty HTML. A figure's caption goes to
    the media that stand before it in the figure; an image without one has its alt text. Broken markup loses no text: what isn't
    closed ends with what is around it."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    reader.end_caption()
    reader.flush()
    return [(i, *x) for i, x in enumerate(reader.items)]


_PART = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())])


def read(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, parts: each page's sequence, an array of structs (position, kind 'text' or 'media', text, ref, caption) in reading order;
    empty for null and empty pages. Rows keep their number; other columns are ignored, whatever their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "html"):
                parts = [[dict(zip(("position", "kind", "text", "ref", "caption"), x, strict=True)) for x in read_html(h)] for h in some.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column("key"), pa.array(parts, pa.list_(_PART))], ["key", "parts"])

    narrow = pages.select(F.col(key).alias("key"), F.col(html).alias("html"))
    part = StructType().add("position", "integer").add("kind", "string").add("text", "string").add("ref", "string").add("caption", "string")
    kind = StructType([narrow.schema["key"]]).add("parts", ArrayType(part))
    return arrow_map(narrow, run, kind).withColumnRenamed("key", key)


def parse(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, position, kind, text, ref, caption: a row per element of read(); pages without elements have none."""
    return read(pages, key, html).select(key, F.explode("parts").alias("p")).select(key, "p.*")


def sequences(parts: DataFrame, key: str = "page_id") -> DataFrame:
    """One row per page again: key, parts (structs in reading order). A page is one row, so this gathers no more than it."""
    item = F.struct("position", "kind", "text", "ref", "caption")
    return parts.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("parts"))


def store(payload: bytes) -> bytes:
    """The stored form of a payload whose length is a positive multiple of ROW."""
    return b"P6\n%d %d\n255\n" % (ROW // 3, len(payload) // ROW) + payload


def load(stored: bytes) -> bytes:
    """The samples of a stored form."""
    magic, size, depth, samples = stored.split(b"\n", 3)
    wide, high = map(int, size.split())
    if (magic, depth) != (b"P6", b"255") or len(samples) != 3 * wide * high:
        raise ValueError("not an 8-bit pixmap of the stated size")
    return samples


def feature(samples: bytes) -> str:
    """Mean and deviation of each colour and an 8-bin histogram of all samples, as rounded integers."""
    x = np.frombuffer(samples, np.uint8)
    rgb = x.reshape(-1, 3)
    bins = np.bincount(x >> 5, minlength=8)
    mean, sd = rgb.mean(axis=0), rgb.std(axis=0)
    return "rgb=" + ",".join(f"{m:.3f}:{d:.3f}" for m, d in zip(mean, sd, strict=True)) + ";hist=" + ",".join(map(str, bins.tolist()))


def payload(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, its payload: filled up with blanks to a positive multiple of ROW)."""
    raw = (text or "").encode()
    return len(raw), raw + b" " * (max(1, -(-len(raw) // ROW)) * ROW - len(raw))


def page_of(digest: str, text: str, n_bytes: int) -> str:
    """A page of a text: its lines as paragraphs and, after the first half of them, the figure that shows its payload by digest."""
    lines = [f"<p>{escape(x, quote=False)}</p>" for x in text.split("\n") if x.strip()]
    half = (len(lines) + 1) // 2
    figure = f'<figure><img src="{SCHEME}{digest}"><figcaption>{escape(f"{n_bytes} bytes of text")}</figcaption></figure>'
    return "<article>" + "".join(lines[:half]) + figure + "".join(lines[half:]) + "</article>"


def as_pages(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, html: each text as a page of its paragraphs, with its payload among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sizes, pages = [], []
                for t in part.column("text").to_pylist():
                    n, p = payload(t)
                    sizes.append(n)
                    pages.append(page_of(hashlib.sha256(store(p)).hexdigest(), t or "", n))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(pages, pa.string())], ["doc_id", "n_bytes", "html"])

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id bigint, n_bytes bigint, html string")


def media_table(docs: DataFrame) -> DataFrame:
    """ref, media: the stored payloads. A batch emits a payload once; equal ones of other tasks meet in resolve()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for part in slices(batch, "text"):
                refs, stored = [], []
                for t in part.column("text").to_pylist():
                    media = store(payload(t)[1])
                    digest = hashlib.sha256(media)
                    if digest.digest() not in seen:
                        seen.add(digest.digest())
                        refs.append(SCHEME + digest.hexdigest())
                        stored.append(media)
                if len(seen) > 200_000:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([pa.array(refs, pa.string()), pa.array(stored, pa.binary())], ["ref", "media"])

    return arrow_map(docs.select("text"), run, "ref string, media binary")


def resolve(refs: DataFrame, media: DataFrame) -> DataFrame:
    """refs with the columns of the media table's row of the same ref, for narrow media tables (facts or places of payloads). Refs that are null
    or that the media table doesn't have go; of several rows of a ref one counts. refs is read three times, so it should be a written table.

    A ref of more than 1 / HOT of all references would be one task's: there are fewer than HOT such refs, so their rows are broadcast.
    """
    one = media.groupBy("ref").agg(*[F.first(c).alias(c) for c in media.columns if c != "ref"])
    one = written(one, "media-facts")
    often = refs.groupBy("ref").agg(F.count("*").alias("_n")).where(F.col("_n") * HOT > refs.count()).select("ref")
    hot = one.join(F.broadcast(often), "ref")  # fewer than HOT rows
    rest = refs.join(F.broadcast(often), "ref", "left_anti").join(one, "ref")
    return refs.join(F.broadcast(hot), "ref").unionByName(rest)


def described(media: DataFrame) -> DataFrame:
    """ref, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of each stored payload, read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for ref, media in zip(batch.column("ref").to_pylist(), batch.column("media"), strict=True):
                media = media.as_py()
                samples = load(media)
                rows.append((ref, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples)))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["ref", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return arrow_map(media.select("ref", "media"), run, "ref string, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")


def document_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, position, caption, n_parts.

    Each text becomes a page of its paragraphs with one figure among them; pages are read as sequences of n_parts elements,
    references (with their position and caption) resolved by digest and payloads read back. Null text is an empty text (192
    blanks); texts are whole, however long. Repeated rows and ids keep their number; equal texts have equal values. Other columns are
    ignored, whatever their names; an empty table gives an empty table.
    """
    pages = read(as_pages(docs).select(F.struct("doc_id", "n_bytes").alias("page"), "html"), "page")
    media = F.filter("parts", lambda p: p["kind"] == "media")
    shown = pages.select("page", F.size("parts").alias("n_parts"), F.explode(F.transform(media, lambda p: p.dropFields("text", "kind"))).alias("m")).select("page.*", "n_parts", "m.*")
    found = resolve(written(shown, "references"), described(media_table(docs)))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption", "n_parts")
