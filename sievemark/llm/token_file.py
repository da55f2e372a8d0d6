"""Operator 9: token ids in word-aligned files (Simple-8b), written, read back and checked.

Format of a shard (one binary value; little-endian):
  4 bytes `SM8B`, u32 version, u64 number of ids, u32 number of words, u32 number of blocks,
  blocks x u32: the word at which each block of BLOCK ids starts (per-block offsets),
  u32 number of documents, documents x u32: ids of each document (its end id included),
  words x u64.
A word's top 4 bits select how many ids its low 60 bits hold and at which width; selector 15 is the escape: one id of
up to 60 bits alone in its word. Blocks are independent, so they are coded and decoded many at a time: encoding walks all
blocks of a shard in lockstep, decoding groups words by selector.

Shards are rows of a Parquet table in the shared folder, so that any store Spark writes to will do and lost tasks are
simply repeated. Documents are range-partitioned and sorted by doc_id (ties by text, then as they come; null ids
first); a shard holds consecutive documents, and (part, shard) order is doc_id order.

Edge cases: null texts are empty texts (the end id alone); very long texts may fill a shard of their own; repeated rows
are encoded one by one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, tidy, written
from .token_count import tokenizer_path

BLOCK = 512
#: Ids in a word and bits of each, by selector; the escape is the last.
SELECTORS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30))
ESCAPE = 15
_MAGIC = b"SM8B"


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, block offsets) of the ids."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    ids = ids.astype(np.uint64)
    top = int(ids.max())
    if top >> 60:
        raise ValueError("an id needs more than 60 bits")
    blocks = -(-n // BLOCK)
    width = np.zeros(blocks * BLOCK, dtype=np.uint8)
    for bits in range(min(31, top.bit_length())):
        width[:n] += ids >= np.uint64(1 << bits)
    # behind a block's end lie places of no width: a word that isn't full ends its block
    padded = np.zeros((blocks, BLOCK + 60), dtype=np.uint8)
    padded[:, :BLOCK] = width.reshape(blocks, BLOCK)
    chosen = np.full((blocks, BLOCK), ESCAPE, dtype=np.uint8)
    count = np.ones((blocks, BLOCK), dtype=np.uint8)
    widest, have = padded[:, :BLOCK].copy(), 1
    for s, (k, bits) in reversed(list(enumerate(SELECTORS))):
        while have < k:  # the widest of the next k ids at each place
            np.maximum(widest, padded[:, have : have + BLOCK], out=widest)
            have += 1
        fits = widest <= bits
        if not fits.any():
            break
        np.copyto(chosen, np.uint8(s), where=fits)
        np.copyto(count, np.uint8(k), where=fits)
    chosen, count = chosen.ravel(), count.ravel().astype(np.int64)
    heads = np.arange(0, n, BLOCK)
    limit = np.minimum(heads + BLOCK, n)
    at, starts, block = heads.copy(), [], []
    live = np.arange(blocks)
    while len(live):
        now = at[live]
        starts.append(now)
        block.append(live)
        now = now + count[now]
        at[live] = now
        live = live[now < limit[live]]
    starts, block = np.concatenate(starts), np.concatenate(block)
    order = np.argsort(starts, kind="stable")
    starts, block = starts[order], block[order]
    selector = chosen[starts]
    words = selector.astype(np.uint64) << np.uint64(60)
    padded = np.concatenate((ids, np.zeros(60, np.uint64)))
    stop = limit[block]
    for s in np.unique(selector):
        mine = np.flatnonzero(selector == s)
        if s == ESCAPE:
            words[mine] |= ids[starts[mine]]
            continue
        k, bits = SELECTORS[s]
        first, end = starts[mine], stop[mine]
        word = np.zeros(len(mine), np.uint64)
        for j in range(k):
            word |= np.where(first + j < end, padded[first + j], np.uint64(0)) << np.uint64(j * bits)
        words[mine] |= word
    return words, np.searchsorted(block, np.arange(len(heads))).astype(np.uint32)


def unpack(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The ids again."""
    if not n:
        return np.zeros(0, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    capacity = np.array([k for k, _ in SELECTORS] + [0, 0, 1])[selector]
    ends = np.append(offsets[1:], len(words)).astype(np.int64)
    block = np.repeat(np.arange(len(offsets)), ends - offsets.astype(np.int64))
    before = np.cumsum(capacity) - capacity
    start = block * BLOCK + before - before[offsets.astype(np.int64)][block]
    limit = np.minimum((block + 1) * BLOCK, n)
    held = np.minimum(capacity, limit - start)
    out = np.zeros(n + 60, np.uint64)
    for s in np.unique(selector):
        mine = np.flatnonzero(selector == s)
        k, bits = (1, 60) if s == ESCAPE else SELECTORS[s]
        mask = np.uint64((1 << bits) - 1)
        for j in range(k):
            some = mine[j < held[mine]]
            out[start[some] + j] = words[some] >> np.uint64(j * bits) & mask
    return out[:n]


def to_bytes(ids: np.ndarray, sizes: np.ndarray) -> bytes:
    words, offsets = pack(ids)
    return b"".join((_MAGIC, struct.pack("<IQII", 1, len(ids), len(words), len(offsets)), offsets.astype("<u4").tobytes(), struct.pack("<I", len(sizes)), sizes.astype("<u4").tobytes(), words.astype("<u8").tobytes()))


def from_bytes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ids, sizes of the documents) of a shard."""
    if raw[:4] != _MAGIC:
        raise ValueError("not a shard of token ids")
    version, n, n_words, n_blocks = struct.unpack_from("<IQII", raw, 4)
    if version != 1:
        raise ValueError(f"unknown version {version}")
    at = 24
    offsets = np.frombuffer(raw, "<u4", n_blocks, at)
    at += 4 * n_blocks
    (docs,) = struct.unpack_from("<I", raw, at)
    sizes = np.frombuffer(raw, "<u4", docs, at + 4)
    words = np.frombuffer(raw, "<u8", n_words, at + 4 + 4 * docs)
    return unpack(words, offsets, n), sizes


class _Known(dict):
    """Ids, as bytes, of chunks that follow `before`; what isn't known is asked for.

    A chunk is kept for good when it is met again while it waits in `once`, whose chunks go when it is full; so the many
    words that come but once don't fill the memory. Chunks over `LONGEST` characters seldom come again and aren't kept."""

    LIMIT, WAITING, LONGEST = 400_000, 250_000, 12

    def __init__(self, encoder: Encoder, before: str):
        super().__init__()
        self.encoder, self.before, self.once = encoder, before, {}

    def __missing__(self, chunk: str) -> bytes:
        once = self.once
        found = once.pop(chunk, None)
        if found is not None:
            if len(self) >= self.LIMIT:
                self.clear()
            self[chunk] = found
            return found
        if chunk.isalpha():
            found = self.encoder.word(self.before + chunk)
        elif chunk[-1:] in self.encoder.marks and chunk[:-1].isalpha():
            body = chunk[:-1]
            found = (self.get(body) or once.get(body) or self.encoder.word(self.before + body)) + self.encoder.marks[chunk[-1]]
        else:
            found = self.encoder.ids(self.before + chunk)
        if len(chunk) <= self.LONGEST:
            if len(once) >= self.WAITING:
                once.clear()
            once[chunk] = found
        return found


class Encoder:
    """The library's ids, asked once for each chunk that texts are made of.

    The vocabulary's split never runs over a single blank between two other characters (a blank opens a piece, never ends
    one), nor over a single line end between two others, so the ids of a text are those of its words behind blanks and
    of its line ends. Texts with other or repeated white space are cut at single blanks only; texts with special strings
    go to the library whole. A word of letters is one piece of the split and goes straight to the library's model; a
    mark behind letters is a piece of its own."""

    _CUT = re.compile(r"(?<=\S)(?= \S)")
    # White space other than single blanks and line ends.
    _ODD = ("  ", " \n", "\n ", "\n\n", "\t", "\v", "\f", "\r", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0", "\u1680", "\u2000", "\u2001", "\u2002", "\u2003", "\u2004", "\u2005", "\u2006", "\u2007", "\u2008", "\u2009", "\u200a", "\u2028", "\u2029", "\u202f", "\u205f", "\u3000")
    _ODD_ASCII = _ODD[:12]

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.tokenize = self.library.model.tokenize
        self.specials = [x.content for x in self.library.get_added_tokens_decoder().values()]
        # the printable letter that stands for each byte in byte-level vocabularies
        shown, rest = {*range(33, 127), *range(161, 173), *range(174, 256)}, iter(range(256, 512))
        self.letters = {b: b if b in shown else next(rest) for b in range(256)}
        self.blank = chr(self.letters[32])
        self.code = "H" if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "I"
        self.marks = {c: self.ids(c) for c in ",."}
        self.line_end = self.ids("\n")
        self.first, self.behind_blank = _Known(self, ""), _Known(self, " ")

    def ids(self, text: str) -> bytes:
        return array(self.code, self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def word(self, word: str) -> bytes:
        """Ids of letters behind at most one blank."""
        shown = word.replace(" ", self.blank) if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return array(self.code, [t.id for t in self.tokenize(shown)]).tobytes()

    def text(self, t: str) -> bytes:
        for s in self.specials:
            if s in t:
                return self.ids(t)
        if t[-1:].isspace() or any([x in t for x in (self._ODD_ASCII if t.isascii() else self._ODD)]):
            return b"".join(map(self.first.__getitem__, self._CUT.split(t)))
        first, more, out = self.first, self.behind_blank.__getitem__, []
        for line in t.split("\n"):
            words = line.split(" ")
            out.append(self.line_end)
            if words[0]:
                out.append(first[words[0]])
            out += map(more, words[1:])
        return b"".join(out[1:])

    def encode(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each followed by end_id; ids of each text)."""
        out, sizes, end = [], [], array(self.code, [end_id]).tobytes()
        for t in texts:
            mine = self.text(t)
            out += (mine, end)
            sizes.append(len(mine) // len(end) + 1)
        return np.frombuffer(b"".join(out), np.dtype(self.code)), np.array(sizes, dtype=np.int64)


@lru_cache(maxsize=4)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def write_shards(docs: DataFrame, vocabulary: str | None = None, end_id: int = 0, shard_chars: int = 1_500_000) -> DataFrame:
    """docs (doc_id, text) -> the written table part, shard, doc_ids, shard_bytes; parts and shards ascend with doc_id."""
    path = vocabulary or tokenizer_path("byte_bpe_50k.json")
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, ids, texts, held, part, arrow = _encoder(path), 0, [], [], 0, None, None

        def emit() -> pa.RecordBatch:
            flat, sizes = encoder.encode(texts, end_id)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([ids], pa.list_(arrow)), pa.array([to_bytes(flat, sizes)], pa.binary())], ["part", "shard", "doc_ids", "shard_bytes"])

        for b in batches:
            parts, keys, arrow = b.column(0), b.column(1).to_pylist(), b.column(1).type
            part = parts[0].as_py() if b.num_rows else part
            for i in range(b.num_rows):
                texts.append(b.column(2)[i].as_py() or "")
                ids.append(keys[i])
                held += len(texts[-1]) + 64
                if held >= shard_chars:
                    yield emit()
                    shard, ids, texts, held = shard + 1, [], [], 0
        if texts:
            yield emit()

    order = ("doc_id", "tie")
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tie")).repartitionByRange(*order).sortWithinPartitions(*order)
    shards = rows.select(F.spark_partition_id().alias("part"), "doc_id", "text").mapInArrow(tidy(run), f"part int, shard int, doc_ids array<{kind.simpleString()}>, shard_bytes binary")
    return written(shards, "shards")


def read_shards(shards: DataFrame) -> DataFrame:
    """The shard table -> doc_id, start, n_tokens, ids_crc32, decoded from the written bytes.

    Starts need the ids before each part: one number for each range partition goes to the driver (as many as
    spark.sql.shuffle.partitions at most), and within a part the shards' own."""
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            heads = [struct.unpack_from("<Q", x.as_py(), 8)[0] for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(heads, pa.int64())], ["part", "shard", "n"])

    totals = shards.select("part", "shard", F.substring("shard_bytes", 1, 24).alias("head")).mapInArrow(tidy(sizes), "part int, shard int, n long")
    totals = written(totals, "shard-sizes")
    parts = sorted(tuple(r) for r in totals.groupBy("part").agg(F.sum("n")).collect())
    before, starts = 0, {}
    for part, n in parts:
        starts[part] = before
        before += n
    place = F.create_map(*(F.lit(x) for kv in starts.items() for x in kv)) if starts else None
    from pyspark.sql import Window

    inner = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = totals.select("part", "shard", (inner + (place[F.col("part")] if starts else F.lit(0))).cast("long").alias("offset"))
    if not starts:
        offsets = totals.select("part", "shard", F.col("n").alias("offset"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids, sizes = from_bytes(b.column(1)[i].as_py())
                ids, ends = ids.astype("<u4"), np.cumsum(sizes, dtype=np.int64)
                cuts = np.concatenate(([0], ends))
                crc = [zlib.crc32(ids[x:y].tobytes()) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0)[i].values, pa.array(b.column(2)[i].as_py() + cuts[:-1], pa.int64()), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # shards are few and wide: their offsets come to them, if small enough without a shuffle of the bytes
    joined = shards.join(offsets, ["part", "shard"]).select("doc_ids", "shard_bytes", "offset")
    return joined.mapInArrow(tidy(decode), f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def encode_and_read(docs: DataFrame) -> DataFrame:
    return read_shards(write_shards(docs))


def op9_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_read(documents(spark, sf_dir))
