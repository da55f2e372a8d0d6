"""Operator 1: language identification by multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of a bounded, hash-chosen sample of labelled rows on the cluster; only the
(language, bucket) log-probability matrix reaches the driver, and it is broadcast. Scoring treats a batch of
texts as one sparse matrix (one unit entry for each n-gram, rows delimited by offsets) times that matrix.

Edge cases: a null text, or one without letters, is `und` with score 0; without any training row every text is;
null languages never train; ties go to the language that sorts first; repeated rows are scored one by one; very
long texts are scored whole, in pieces in which every n-gram begins once; with many languages there are fewer buckets, so
that the matrix keeps its size; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fold, tidy, unit_hash

UNDETERMINED = "und"
_FOLD_SIZE = 0x33480
_PIECE = 1 << 20
_fold_table: np.ndarray | None = None


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    log_prior: np.ndarray  # (languages,)
    log_prob: np.ndarray  # (languages, buckets + 1); the last bucket weighs nothing
    orders: tuple[int, ...] = (2, 3)


def letters(codes: np.ndarray) -> np.ndarray:
    """Lower-case code points of letters, 0 for all else."""
    global _fold_table
    if _fold_table is None:
        low = [chr(i).lower() if chr(i).isalpha() else "\0" for i in range(_FOLD_SIZE)]
        _fold_table = np.array([ord(c) if len(c) == 1 else i for i, c in enumerate(low)], dtype=np.uint32)
        _fold_table[-1] = 0
    return _fold_table[np.minimum(codes, _FOLD_SIZE - 1)]


def bucketed(f: np.ndarray, n: int, buckets: int) -> np.ndarray:
    """Bucket of the n-gram at each place of the folded codes, `buckets` where it holds two blanks in a row."""
    m = len(f) - n + 1
    h = np.full(m, 0x9E3779B1 * n & 0xFFFFFFFF, dtype=np.uint32)
    for k in range(n):
        h ^= f[k : k + m]
        h *= np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
    h = (h >> np.uint32(7)) % np.uint32(buckets)
    blank = f == 0
    two = blank[:-1] & blank[1:]
    for k in range(n - 1):
        h[two[k : k + m]] = buckets
    return h


def pieces(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(folded codes, starts, indices of the texts) for runs of about a million characters, each text framed by blanks.

    Texts over _PIECE characters are left to `long_text`."""
    def packed(batch: list[tuple[int, str]]):
        codes = np.frombuffer("".join(f" {t}  " for _, t in batch).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        starts = np.cumsum([0, *(len(t) + 3 for _, t in batch)])[:-1]
        return letters(codes), starts, np.array([i for i, _ in batch])

    batch, held = [], 0
    for i, t in enumerate(texts):
        if len(t) > _PIECE:
            continue
        batch.append((i, t))
        held += len(t)
        if held > _PIECE:
            yield packed(batch)
            batch, held = [], 0
    if batch:
        yield packed(batch)


def long_text(text: str, orders: tuple[int, ...], buckets: int) -> tuple[np.ndarray, bool]:
    """(how often each bucket occurs in the framed text, whether it has letters): every n-gram begins in one piece."""
    counts, seen = np.zeros(buckets + 1, dtype=np.int64), False
    whole = f" {text}  "
    for at in range(0, len(whole), _PIECE):
        f = letters(np.frombuffer(whole[at : at + _PIECE + max(orders) - 1].encode("utf-32-le", "surrogatepass"), dtype=np.uint32))
        seen = seen or bool(f.any())
        for n in orders:
            part = f[: _PIECE + n - 1]
            if len(part) >= n:
                counts += np.bincount(bucketed(part, n, buckets), minlength=buckets + 1)
    return counts, seen


def predict(model: LanguageModel, texts: list[str | None]) -> tuple[list[str], list[float]]:
    langs, buckets = len(model.languages), model.log_prob.shape[1] - 1
    total, seen = np.zeros((len(texts), max(langs, 1))), np.zeros(len(texts), dtype=bool)
    if langs:
        whole = [t or "" for t in texts]
        for f, starts, which in pieces(whole):
            seen[which] |= np.maximum.reduceat(f, starts) > 0
            for n in model.orders:
                if len(f) < n:
                    continue
                h = bucketed(f, n, buckets)
                at = np.minimum(starts, len(h) - 1)
                for k in range(langs):
                    total[which, k] += np.add.reduceat(model.log_prob[k][h], at)
        for i, t in enumerate(whole):
            if len(t) > _PIECE:
                counts, seen[i] = long_text(t, model.orders, buckets)
                total[i] += model.log_prob @ counts
        total += model.log_prior
    best = total.argmax(axis=1)
    score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
    return [model.languages[b] if s else UNDETERMINED for b, s in zip(best, seen, strict=True)], [round(float(x), 9) if s else 0.0 for x, s in zip(score, seen, strict=True)]


def train(docs: DataFrame, may_train: Column, docs_per_language: int = 1500, buckets: int = 1 << 16, orders: tuple[int, ...] = (2, 3), smoothing: float = 0.5, max_languages: int = 10_000, most_cells: int = 1 << 24) -> LanguageModel:
    """Fit on rows where may_train holds and lang is not null.

    At most about `docs_per_language` rows of a language are read (hash-chosen in proportion, so that the sample's
    size doesn't follow the corpus). The sample's counts have at most languages x buckets rows, and where that would be
    more than `most_cells` (128 MB of log-probabilities) there are fewer buckets. More than max_languages raise."""
    rows = docs.where(may_train & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    sizes = rows.groupBy("lang").count().limit(max_languages + 1).collect()
    if len(sizes) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not sizes:
        return LanguageModel([], np.zeros(0), np.zeros((0, buckets + 1)), orders)
    sizes = {r["lang"]: r["count"] for r in sorted(sizes)}
    buckets = min(buckets, most_cells // len(sizes))
    part = F.create_map(*(x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, docs_per_language / n)))))
    sample = rows.where(unit_hash(F.col("doc_id"), F.col("text"), seed=11) < part[F.col("lang")]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            lang, text = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, t in enumerate(text):
                if t and len(t) > _PIECE:
                    sums.setdefault(lang[i], np.zeros(buckets + 1, dtype=np.int64))
                    sums[lang[i]] += long_text(t, orders, buckets)[0]
            for f, starts, which in pieces([t or "" for t in text]):
                ends = [*starts[1:], len(f)]
                for i, s, e in zip(which, starts, ends, strict=True):
                    into = sums.setdefault(lang[i], np.zeros(buckets + 1, dtype=np.int64))
                    for n in orders:
                        if e - s >= n:
                            into += np.bincount(bucketed(f[s:e], n, buckets), minlength=buckets + 1)
        for k, v in sums.items():
            at = np.flatnonzero(v[:-1])
            yield pa.RecordBatch.from_pydict({"lang": pa.array([k] * len(at), pa.string()), "bucket": pa.array(at, pa.int32()), "n": pa.array(v[at], pa.int64())})

    counts = sample.mapInArrow(tidy(count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = list(sizes)
    table = np.full((len(languages), buckets), smoothing)
    of = {k: i for i, k in enumerate(languages)}
    table[[of[x] for x in counts["lang"].to_pylist()], counts["bucket"].to_numpy()] += counts["n"].to_numpy()
    log_prob = np.zeros((len(languages), buckets + 1))
    log_prob[:, :-1] = np.log(table / table.sum(axis=1, keepdims=True))
    prior = np.array(list(sizes.values()), dtype=float)
    return LanguageModel(languages, np.log(prior / prior.sum()), log_prob, orders)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs (doc_id, text) -> doc_id, lang_pred, score, in one pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, p = predict(shared.value, b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(p, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(tidy(score), f"doc_id {kind}, lang_pred string, score double")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, fold() != 2)
    return identify(docs, model).select("doc_id", (fold() == 2).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows whose language is told with at least that posterior, all columns as they were.

    The decision needs the text beside it, so the texts pass through the workers once and nothing is joined."""
    model = train(docs, fold() != 2)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, p = predict(shared.value, b.column(at).to_pylist())
            yield b.filter(pa.array([x != UNDETERMINED and y >= least for x, y in zip(lang, p, strict=True)], pa.bool_()))

    return docs.mapInArrow(tidy(keep), docs.schema)
