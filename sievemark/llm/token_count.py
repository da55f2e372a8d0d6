"""Operator 3: token counts by rank-synchronous merging of ragged arrays.

Texts are normalised and split as the vocabulary file says (lower case, canonical composition, letters / single
digits / other marks). Chunks between blanks never share a token, so counts are kept by chunk in a bounded cache;
the chunks a batch has and the cache lacks become one flat symbol array with offsets. In each step every sequence
merges all places of its lowest-ranked pair at once (left to right where places overlap), until no pair has a rank;
the surviving symbols are counted. Equal to the library's result because no merge can create a pair of lower rank.

Edge cases: null and empty texts have no tokens; special strings inside a text are one token each, as the library
does by default; very long texts and chunks are whole; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import documents, tidy

_NONE = np.int64(1 << 40)
_CACHE_LIMIT = 400_000


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordBpe:
    """A lower-casing BPE vocabulary with word ends, read from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, self.suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        self.size = len(vocab)
        pairs = np.array([(vocab[a], vocab[b], vocab[a + (b if not a.endswith(self.suffix) else b)]) for a, b in spec["model"]["merges"]], dtype=np.int64)
        keys = pairs[:, 0] * self.size + pairs[:, 1]
        order = np.argsort(keys)
        self.keys, self.ranks, self.merged = keys[order], order.astype(np.int64), pairs[order, 2]
        plain = self._byte_letters()
        self.inner = np.array([vocab[c] for c in plain], dtype=np.int64)
        self.final = np.array([vocab[c + self.suffix] for c in plain], dtype=np.int64)
        self.specials = [x["content"] for x in spec["added_tokens"] if x["special"]]
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")") if self.specials else None
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.cache: dict[str, int] = {}

    @staticmethod
    def _byte_letters() -> list[str]:
        """The printable letter that stands for each byte in byte-level vocabularies."""
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = iter(range(256, 512))
        return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], _NONE), self.merged[at]

    def count_words(self, words: list[bytes]) -> np.ndarray:
        """Tokens of each word, given as UTF-8 bytes."""
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        symbols = self.inner[raw]
        ends = np.cumsum(sizes) - 1
        symbols[ends] = self.final[raw[ends]]
        owner = np.repeat(np.arange(len(words)), sizes)
        result = np.ones(len(words), dtype=np.int64)
        while len(symbols):
            same = owner[:-1] == owner[1:]
            rank, merged = self.ranks_of(symbols[:-1], symbols[1:])
            rank = np.where(same, rank, _NONE)
            rank = np.append(rank, _NONE)
            starts = np.flatnonzero(np.append(True, ~same))
            lowest = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.append(starts, len(symbols)))
            done = lowest == _NONE
            if done.any():  # finished sequences leave the arrays
                result[owner[starts[done]]] = lengths[done]
                live = np.repeat(~done, lengths)
                symbols, owner, rank = symbols[live], owner[live], rank[live]
                merged = np.append(merged, 0)[live]
                lowest, lengths = lowest[~done], lengths[~done]
                if not len(symbols):
                    break
            take = rank == np.repeat(lowest, lengths)
            # in a run of neighbouring places (a pair of equal symbols) every second one merges
            at = np.flatnonzero(take)
            run = np.cumsum(np.append(True, np.diff(at) > 1)) - 1
            first = np.flatnonzero(np.append(True, np.diff(at) > 1))
            at = at[(at - at[first][run]) % 2 == 0]
            symbols[at] = merged[at] if len(merged) > at[-1] else np.append(merged, 0)[at]
            keep = np.ones(len(symbols), dtype=bool)
            keep[at + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        return result

    def _learn(self, chunks: set[str]) -> None:
        """Put the counts of these chunks into the cache."""
        split = [(c, self.words.findall(c)) for c in chunks]
        words = list({w for _, ws in split for w in ws if w not in self.cache})
        sizes: dict[str, int] = {}
        for i in range(0, len(words), 50_000):
            part = words[i : i + 50_000]
            sizes.update(zip(part, self.count_words([w.encode("utf-8", "surrogatepass") for w in part]).tolist(), strict=True))
        known = self.cache
        new = {c: sum(sizes[w] if w in sizes else known[w] for w in ws) for c, ws in split}
        known.update(new)

    def count(self, texts: list[str | None]) -> list[int]:
        if len(self.cache) > _CACHE_LIMIT:
            self.cache.clear()
        parts, special = [], []
        for t in texts:
            t, extra = t or "", 0
            if self.special_split and any(s in t for s in self.specials):
                found = self.special_split.split(t)
                extra = len(found) // 2
                chunks = [c for x in found[::2] for c in self._chunks(x)]
            else:
                chunks = self._chunks(t)
            parts.append(chunks)
            special.append(extra)
        get = self.cache.get
        missing = set()
        for chunks in parts:
            missing.update(chunks)
        missing -= self.cache.keys()
        if missing:
            self._learn(missing)
        return [sum(map(get, chunks)) + extra for chunks, extra in zip(parts, special, strict=True)]

    @staticmethod
    def _chunks(text: str) -> list[str]:
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # letters are lowered one by one: no final form
                text = text.replace("Σ", "σ")
        if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:  # marks to the vocabulary, blanks to str.split
            return regex.split(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+", text.lower())
        return text.lower().split()


@lru_cache(maxsize=4)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def count_tokens(docs: DataFrame, vocabulary: str | None = None, limit: int = 2048, batch_chars: int = 4_000_000) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_bytes, n_tokens, over_limit; one pass, no shuffle.

    `vocabulary` is the path of a tokenizer file that every worker can read."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    path = vocabulary or tokenizer_path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for b in batches:
            at = 0
            while at < b.num_rows:  # slices of bounded size: batches of long texts stay small
                texts, held, end = [], 0, at
                while end < b.num_rows and held < batch_chars:
                    texts.append(b.column(1)[end].as_py())
                    held += len(texts[-1] or "")
                    end += 1
                n = bpe.count(texts)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, end - at), pa.array([len((t or "").encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])
                at = end

    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op3_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir))
