"""Media columns: interleaved sequences of text and media from HTML, with payloads resolved by digest.

`interleave` parses a page into a sequence of structs, text or media reference, each with its position, a reference with its caption. `store_texts`
keeps payloads as media (8-bit PCM in WAVE) under the digest of what is stored; `read_back` takes them from there. `resolve` joins
references and media by digest, so positions and captions stay with their payload. Equal media are one row before the join.
"""

from __future__ import annotations

import hashlib
import html as entities
import io
import wave
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import column, on_executors, stored, to_batch, utf8

SCHEME = "media:"
UNIT = 64
_RATE = 8000
_SILENT = {"script", "style", "template", "noscript"}
_BREAKS = {"p", "div", "br", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "figure", "figcaption", "table", "tr", "td", "title", "head", "body", "nav", "blockquote", "pre"}
_MEDIA = {"img", "video", "audio", "source", "embed"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Events(HTMLParser):
    """A page as a list of (kind, tag, attributes or data); kind is start, end or data."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.events: list[tuple] = []

    def handle_starttag(self, tag, attrs):
        self.events.append(("start", tag, dict(attrs)))

    def handle_endtag(self, tag):
        self.events.append(("end", tag, None))

    def handle_data(self, data):
        self.events.append(("data", None, data))


def _ends(events: list[tuple]) -> dict[int, int]:
    """Where elements that matter here end, by the event that opens them.

    An element ends at its own end tag, or at that of an element around it; hidden ones only at their own, so that one which is left open hides
    nothing. A caption that is left open till the end of the page ends at the next tag that begins a block.
    """
    ends: dict[int, int] = {}
    open_: list[tuple[str, int]] = []
    number: Counter[str] = Counter()  # of open elements by tag
    last_raw = None
    for k, (kind, tag, _) in enumerate(events):
        if kind == "start" and tag not in _VOID:
            open_.append((tag, k))
            number[tag] += 1
            last_raw = k if tag in ("script", "style") else last_raw
        elif kind == "end" and number[tag]:
            while True:
                t, start = open_.pop()
                number[t] -= 1
                if t == tag or t not in _SILENT:
                    ends[start] = k
                if t == tag:
                    break
    for tag, start in open_:
        if tag == "figcaption":
            ends[start] = next((k for k in range(start + 1, len(events)) if events[k][0] == "start" and events[k][1] in _BREAKS), len(events))
        elif tag not in _SILENT or start == last_raw:  # what follows an open script or style is its content, not text
            ends[start] = len(events)
    return ends


def items(html: str | None) -> list[dict]:
    """A page's texts and media references in order, each with kind, text, ref and caption.

    A reference's caption is that of the innermost figure around it, wherever in the figure it stands, or else its alternative text. A caption
    of a figure without media is a text. Broken markup loses no text: see `_ends`. Null and empty pages have none.
    """
    parser = _Events()
    parser.feed(html or "")
    parser.close()
    events, ends = parser.events, _ends(parser.events)
    out: list[dict] = []
    words: list[str] = []
    figures: list[dict] = []
    hidden = caption_end = -1
    caption: list[str] | None = None

    def end_text() -> None:
        text = " ".join("".join(words).split())
        words.clear()
        if text:
            out.append({"kind": "text", "text": text, "ref": None, "caption": None})

    def end_caption() -> None:
        nonlocal caption
        text = " ".join("".join(caption).split())
        caption = None
        if text and figures:
            figures[-1]["captions"].append((len(out), text))
        elif text:
            out.append({"kind": "text", "text": text, "ref": None, "caption": None})

    def end_figure() -> None:
        figure = figures.pop()
        if figure["media"]:
            for item in figure["media"]:
                item["caption"] = " ".join(t for _, t in figure["captions"]) or item["caption"]
        else:
            for at, text in reversed(figure["captions"]):
                out.insert(at, {"kind": "text", "text": text, "ref": None, "caption": None})

    for k, (kind, tag, value) in enumerate([*events, ("end", None, None)]):
        if caption is not None and k >= caption_end:
            end_caption()
        while figures and k >= figures[-1]["end"]:
            end_text()
            end_figure()
        if k < hidden:
            continue
        if kind == "data":
            (words if caption is None else caption).append(value)
            continue
        if tag in _BREAKS or tag in _MEDIA:
            if caption is None:
                end_text()
            else:
                caption.append(" ")
        if kind == "start" and tag in _SILENT and k in ends:
            hidden = ends[k]
        elif kind == "start" and tag == "figure":
            figures.append({"end": ends[k], "media": [], "captions": []})
        elif kind == "start" and tag == "figcaption" and caption is None:
            caption, caption_end = [], ends[k]
        elif kind == "start" and tag in _MEDIA and value.get("src"):
            out.append({"kind": "media", "text": None, "ref": value["src"], "caption": value.get("alt")})
            if figures:
                figures[-1]["media"].append(out[-1])
    end_text()
    return out


_STRUCT = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())])
_SEQUENCE = "array<struct<position: int, kind: string, text: string, ref: string, caption: string>>"
_PAGES = pa.schema([("page_id", pa.int64()), ("sequence", pa.list_(_STRUCT))])
_MADE = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("html", pa.string()), ("digest", pa.string()), ("media", pa.binary())])
_READ = pa.schema([("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
_READ_TYPE = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def sequence(html: str | None) -> list[dict]:
    return [{"position": k, **x} for k, x in enumerate(items(html))]


def sequences_of(batches):
    for batch in batches:
        yield to_batch(_PAGES, column(batch, "page_id"), [sequence(h) for h in column(batch, "html").to_pylist()])


def to_media(payload: bytes) -> bytes:
    """8-bit mono PCM in WAVE, one sample for each byte."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(_RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_media(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media)) as w:
        return w.readframes(w.getnframes())


def feature(samples: bytes) -> str:
    """Mean, deviation, share of steps over the middle, and shares of eight bands of the samples."""
    a = np.frombuffer(samples, np.uint8)
    up = a >= 128
    bands = np.bincount(a >> 5, minlength=8) / len(a)
    return f"mean={a.mean():.4f};dev={a.std():.4f};cross={(up[1:] != up[:-1]).mean():.6f};bands=" + ",".join(f"{b:.6f}" for b in bands)


def made_of(batches, unit: int):
    for batch in batches:
        rows, size, seen = [], 0, set()
        for i, t in zip(column(batch, "doc_id").to_pylist(), utf8(batch), strict=True):
            t = t or b""
            media = to_media(t + b"\0" * (-len(t) % unit or (0 if t else unit)))
            digest = hashlib.sha256(media).hexdigest()
            page = f'<article><h1>{i}</h1><figure><img src="{SCHEME}{digest}" alt="{len(t)}"><figcaption>{entities.escape(f"payload of {i}")}</figcaption></figure></article>'
            rows.append((i, len(t), page, digest, None if digest in seen else media))
            seen.add(digest)
            size += len(media)
            if size > 1 << 23:
                yield to_batch(_MADE, *zip(*rows, strict=True))
                rows, size = [], 0
        if rows:
            yield to_batch(_MADE, *zip(*rows, strict=True))


def read_of(batches):
    for batch in batches:
        rows = []
        for digest, media in zip(*(column(batch, c).to_pylist() for c in ("digest", "media")), strict=True):
            p = from_media(media)
            rows.append((digest, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature(p)))
        if rows:
            yield to_batch(_READ, *zip(*rows, strict=True))


def interleave(pages: DataFrame) -> DataFrame:
    """A row for each page (page_id long, html string): page_id, sequence (structs of position, kind (text or media), text, ref, caption).

    Null and empty pages have an empty sequence; other columns are not read.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html"))
    return pages.mapInArrow(on_executors("media", "sequences_of"), f"page_id long, sequence {_SEQUENCE}")


def store_texts(docs: DataFrame, unit: int = UNIT) -> DataFrame:
    """A table in the shared folder for docs (doc_id, text): doc_id, n_bytes, html (a page that refers to the text's media), digest, media (null for what a row before has).

    A null text counts as empty; payloads are filled up with zero bytes to a positive multiple of `unit`.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(docs.mapInArrow(on_executors("media", "made_of", unit), "doc_id long, n_bytes long, html string, digest string, media binary"), "media")


def read_back(store: DataFrame) -> DataFrame:
    """One row for each digest of a store: what its stored bytes hold."""
    read = store.where("media is not null").select("digest", "media").mapInArrow(on_executors("media", "read_of"), _READ_TYPE)
    return read.groupBy("digest").agg(*(F.first(c).alias(c) for c in read.columns if c != "digest"))


def resolve(sequences: DataFrame, media: DataFrame) -> DataFrame:
    """The media references of sequences (a column `sequence`, any others), a row each: the other columns, the struct's, digest and the columns of
    media (by digest), null where there is no such media. Position and caption come from the struct, so they stay with their payload."""
    others = [c for c in sequences.columns if c != "sequence"]
    found = sequences.select(*others, F.inline(F.filter("sequence", lambda x: x["kind"] == "media")))
    digest = F.nullif(F.regexp_extract("ref", f"^{SCHEME}([0-9a-f]{{64}})$", 1), F.lit(""))
    return found.withColumn("digest", digest).join(media, "digest", "left")


def media_rows(docs: DataFrame) -> DataFrame:
    """A row for each row of docs (doc_id long, text string): doc_id, position, caption, n_items and what was read back for it.

    Repeated rows have a row each; equal texts have equal media. Other columns are not read. An empty table gives an empty result.
    """
    store = store_texts(docs)
    schema = f"doc_id long, n_bytes long, n_items int, sequence {_SEQUENCE}"
    sequences = store.select("doc_id", "n_bytes", "html").mapInArrow(on_executors("media", "pages_of"), schema)
    rows = resolve(sequences, read_back(store))
    return rows.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption", "n_items")


def pages_of(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_items", pa.int32()), ("sequence", pa.list_(_STRUCT))])
    for batch in batches:
        found = [sequence(h) for h in column(batch, "html").to_pylist()]
        yield to_batch(schema, column(batch, "doc_id"), column(batch, "n_bytes"), [len(x) for x in found], found)
