"""Operator 6: substring deduplication by relative Lempel-Ziv parsing.

The reference of a document is the corpus in front of it: all documents of smaller id. It is indexed by anchors: each
window of `window` words is governed by the least hash among its `gram`-word pieces (a minimizer), so equal windows
always meet at equal anchors, and a document needs one index row for about every 22 words. An anchor with the windows it
governs is a phrase; the index, dealt by anchor over its partitions, is the set of reference blocks, and each of them is
asked for every document that has one of its anchors. An anchor that only one document has leads nowhere.

1. Factors: a phrase that an earlier document has points to the first one that has it, and to the place there. The parse
   goes through a document's phrases from left to right and lets a factor grow as long as the next phrase goes on at the
   same reference and distance. Each phrase is at least a window long, so every factor is long enough.
2. Factor boundaries: where an anchor has several phrases (copies end or begin near it), the windows of each phrase's
   first occurrence are hashed one by one, and a window that a smaller document has too is a factor of its own.

The factors' words are removed. An anchor's hash together with the phrase's or window's hash makes 128 bits. Phrases are
reduced to their first occurrence before anything is joined, so a passage in a third of all documents costs one row for
each of its occurrences and never a pair; anchors, phrases and windows with very many occurrences meet theirs as a
broadcast of counted size instead of in a task of their own.

Edge cases: null texts have no words; a document of fewer words than a window keeps all; a repeat within one document is
kept; rows of equal doc_id never remove each other's words, rows of null doc_id neither lose words nor make others lose
them; repeated rows give repeated results; an empty table gives an empty result; long texts are whole (the index
takes them in overlapping pieces of `_PIECE` words); other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shuffles import skew_join
from .common import discard, documents, tidy, written

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POSITION = 24
_BATCH_WORDS = 200_000
_PIECE = 4_000_000


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Hashed:
    """Words of consecutive texts as hashes; hashes of any stretch of them in constant time."""

    def __init__(self, texts: list[list[bytes]]):
        self.sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.ends = np.cumsum(self.sizes)
        digest = xxhash.xxh3_64_intdigest
        self.words = np.fromiter((digest(w) for t in texts for w in t), dtype=np.uint64, count=int(self.sizes.sum()))
        n = len(self.words)
        steps = np.full(n + 1, _BASE, dtype=np.uint64)
        steps[0] = 1
        back = np.full(n + 1, _INVERSE, dtype=np.uint64)
        back[0] = 1
        self.back = np.cumprod(back)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.words * np.cumprod(steps)[:n], dtype=np.uint64)))

    def stretch(self, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.back[start] + np.uint64(salt * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF))


def anchors(h: Hashed, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, span hash, first, last governed window) of all texts, places counted over all words."""
    n = len(h.words)
    many = window - gram + 1
    if n < window:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
    at = np.arange(n - gram + 1)
    grams = h.stretch(at, at + gram)
    low = np.uint64((1 << _POSITION) - 1)
    least, width = (grams & ~low) | at.astype(np.uint64), 1
    while 2 * width <= many:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < many:
        least = np.minimum(least[: len(least) - (many - width)], least[many - width :])
    place = (least & low).astype(np.int64)  # of the governing piece, by window start
    start = np.arange(len(place))
    inside = np.repeat(h.ends, h.sizes)[start] >= start + window
    start, place = start[inside], place[inside]
    if not len(start):
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
    new = np.append(True, place[1:] != place[:-1])
    first, key = start[new], place[new]
    last = start[np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1)]
    shape = _mixed((last - first).astype(np.uint64) * np.uint64(1 << 20) + (key - first).astype(np.uint64))
    return grams[key], h.stretch(first, last + window, 1) ^ shape, first, last


def _batches(texts: list[str | None]) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Split texts, in runs of about _BATCH_WORDS words (a longer text alone), with the index of the first."""
    run, held, first = [], 0, 0
    for i, t in enumerate(texts):
        words = (t or "").encode("utf-8", "surrogatepass").split()
        if run and held + len(words) > _BATCH_WORDS:
            yield first, run
            run, held, first = [], 0, i
        run.append(words)
        held += len(words)
    if run:
        yield first, run


def _pieces(texts: list[list[bytes]], window: int) -> Iterator[tuple[list[int], list[int], list[list[bytes]]]]:
    """(text, first word, words) in lists; texts over _PIECE words in pieces that share window - 1 words, each alone."""
    short = [k for k, t in enumerate(texts) if len(t) <= _PIECE]
    if short:
        yield short, [0] * len(short), [texts[k] for k in short]
    for k, t in enumerate(texts):
        if len(t) > _PIECE:
            for at in range(0, len(t) - window + 1, _PIECE - window + 1):
                yield [k], [at], [t[at : at + _PIECE]]


def _index(docs: DataFrame, window: int, gram: int) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in _batches(b.column(2).to_pylist()):
                for which, begin, parts in _pieces(texts, window):
                    h = Hashed(parts)
                    key, span, first, last = anchors(h, window, gram)
                    part = np.searchsorted(h.ends, first, side="right")
                    base = (h.ends - h.sizes)[part] - np.array(begin, dtype=np.int64)[part]
                    rows = pa.array(at + np.array(which, dtype=np.int64)[part])
                    yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(key.view(np.int64)), pa.array(span.view(np.int64)), pa.array((first - base).astype(np.int32)), pa.array((last - base).astype(np.int32))], ["doc_id", "th", "anchor", "span", "first", "last"])

    return docs.mapInArrow(tidy(run), f"doc_id {kind}, th long, anchor long, span long, first int, last int")


def _windows(docs: DataFrame, window: int) -> DataFrame:
    """docs with `open` (anchor, span, first, last) -> anchor, span, hash, i, doc_id of each window in them."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = b.column(2).to_pylist()
            for at, texts in _batches(b.column(1).to_pylist()):
                h = Hashed(texts)
                mine = [(at + k, s["anchor"], s["span"], int(e - n) + s["first"], s["last"] - s["first"] + 1) for k, (e, n) in enumerate(zip(h.ends, h.sizes, strict=True)) for s in spans[at + k]]
                if not mine:
                    continue
                row, anchor, span, first, count = (np.array(x, dtype=np.int64) for x in zip(*mine, strict=True))
                i = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                start = np.repeat(first, count) + i
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(anchor, count)), pa.array(np.repeat(span, count)), pa.array(h.stretch(start, start + window, 2).view(np.int64)), pa.array(i.astype(np.int32)), b.column(0).take(pa.array(np.repeat(row, count)))], ["anchor", "span", "hash", "i", "doc_id"])

    return docs.mapInArrow(tidy(run), f"anchor long, span long, hash long, i int, doc_id {kind}")


def duplicate_factors(keyed: DataFrame, window: int = 50, gram: int = 8) -> DataFrame:
    """keyed (doc_id, th, text) -> doc_id, th, hits (from, to: word offsets, to exclusive; reference: an earlier document;
    shift: how much further right it stands there, null at boundaries), by from; rows that have any."""
    keyed = keyed.where("doc_id is not null")
    index = written(_index(keyed.select("doc_id", "th", "text"), window, gram), "anchors")
    shared = index.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("rows")).where("low < high")
    shared = written(shared.select("anchor", "rows"), "shared")
    found = written(skew_join(index, shared, ["anchor"], "rows").select(*index.columns), "found")
    phrases = found.groupBy("anchor", "span").agg(F.min(F.struct("doc_id", "th", "first", "last")).alias("least"), F.count("*").alias("rows"))
    phrases = written(phrases, "phrases")
    refer = phrases.select("anchor", "span", "rows", F.col("least.doc_id").alias("reference"), F.col("least.first").alias("there"))
    whole = skew_join(found, refer, ["anchor", "span"], "rows").where("doc_id > reference")
    whole = whole.select("doc_id", "th", "first", "last", "reference", (F.col("there") - F.col("first")).alias("shift"))
    several = written(phrases.groupBy("anchor").agg(F.count("*").alias("phrases")).where("phrases > 1"), "several")
    opened = skew_join(phrases.drop("rows"), several, ["anchor"], "phrases").select("anchor", "span", "least.*")
    by_doc = opened.groupBy("doc_id", "th").agg(F.collect_list(F.struct("anchor", "span", "first", "last")).alias("open"))
    # repeated rows would open the same windows again
    texts = keyed.join(by_doc, ["doc_id", "th"]).select("doc_id", "text", "open")
    windows = written(_windows(texts, window).dropDuplicates(["anchor", "span", "i"]), "windows")
    least = windows.groupBy("anchor", "hash").agg(F.min("doc_id").alias("reference"), F.max("doc_id").alias("high"), F.count("*").alias("rows")).where("reference < high").drop("high")
    least = written(least, "least")
    edge = skew_join(windows, least, ["anchor", "hash"], "rows").where("doc_id > reference").select("anchor", "span", "doc_id", "i", "reference")
    at = F.col("first") + F.col("i")
    edge = edge.join(found, ["anchor", "span", "doc_id"]).select("doc_id", "th", at.alias("first"), at.alias("last"), "reference", F.lit(None).cast("int").alias("shift"))
    hit = F.struct(F.col("first").alias("from"), (F.col("last") + window).alias("to"), "reference", "shift")
    hits = written(whole.unionByName(edge).groupBy("doc_id", "th").agg(F.sort_array(F.collect_set(hit)).alias("hits")), "hits")
    discard(index, shared, found, phrases, several, windows, least)
    return hits


def parse(hits: list[dict]) -> list[tuple]:
    """Factors (from, to, reference, shift) from hits in order: a factor grows while the next hit goes on in it."""
    out: list[tuple] = []
    for x in hits:
        if out and x["shift"] is not None and (x["reference"], x["shift"]) == out[-1][2:] and x["from"] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], x["to"]), *out[-1][2:])
        else:
            out.append((x["from"], x["to"], x["reference"], x["shift"]))
    return out


def remove_duplicates(docs: DataFrame, window: int = 50, gram: int = 8) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_words, n_removed, n_factors, kept_sha256, kept (the remaining text), factors (from, to,
    reference): the parse's long factors, which cover the removed words."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    hits = duplicate_factors(keyed, window, gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, gone, sha, kept, factors = [], [], [], [], []
            factor = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32()), ("reference", b.schema.field(0).type)]))
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                n = len(words)
                rest, at = [], 0
                mine = parse(spans or [])
                for first, to, *_ in mine:
                    if first > at:
                        rest += words[at:first]
                    at = max(at, to)
                rest = words if not at else rest + words[at:]
                joined = b" ".join(rest)
                sizes.append(n)
                gone.append(n - len(rest))
                sha.append(hashlib.sha256(joined).hexdigest())
                kept.append(joined)
                factors.append([{"from": x[0], "to": x[1], "reference": x[2]} for x in mine])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(map(len, factors), pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(factors, factor)], ["doc_id", "n_words", "n_removed", "n_factors", "kept_sha256", "kept", "factors"])

    same = (F.col("d") == F.col("doc_id")) & (F.col("t") == F.col("th"))
    marked = keyed.join(hits.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "hits"), same, "left").select("doc_id", "text", "hits")
    return marked.mapInArrow(tidy(run), f"doc_id {kind}, n_words long, n_removed long, n_factors long, kept_sha256 string, kept string, factors array<struct<from:int,to:int,reference:{kind}>>")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_duplicates(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP6_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, ws, unnest(range(len(ws) - 49)) AS p FROM w WHERE len(ws) >= 50
), g AS (
  SELECT doc_id, p, array_to_string(ws[p + 1:p + 50], ' ') AS k FROM s
), m AS (
  SELECT k, min(doc_id) AS low FROM g GROUP BY k HAVING min(doc_id) < max(doc_id)
), d AS (
  SELECT DISTINCT g.doc_id, unnest(range(g.p, g.p + 50)) AS i FROM g JOIN m USING (k) WHERE g.doc_id > m.low
), r AS (
  SELECT doc_id, list(i) AS gone FROM d GROUP BY doc_id
), u AS (
  SELECT w.doc_id, unnest(w.ws) AS x, unnest(range(len(w.ws))) AS i FROM w
), t AS (
  SELECT u.doc_id, string_agg(u.x, ' ' ORDER BY u.i) AS kept FROM u ANTI JOIN d ON u.doc_id = d.doc_id AND u.i = d.i GROUP BY u.doc_id
)
SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, coalesce(len(r.gone), 0)::BIGINT AS n_removed, sha256(coalesce(t.kept, '')) AS kept_sha256
FROM w LEFT JOIN r ON w.doc_id = r.doc_id LEFT JOIN t ON w.doc_id = t.doc_id
"""
