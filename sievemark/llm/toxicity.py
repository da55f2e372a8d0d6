"""Operator 8: toxicity by a linear-chain conditional random field.

Training reads a bounded, hash-chosen sample of labelled documents, whole. Words (or beginnings of words) that stand far more
often in toxic documents than in others give token labels: such a word in a toxic document is toxic, any other token is not,
and all tokens of clean documents are not. A two-state chain is fitted to these labels by gradient ascent on its exact
log-likelihood: emission weights (features of a token are itself, its first four and five letters, and its neighbours) by gold
minus marginals, transition weights by gold minus pairwise marginals. Forward-backward marginals are computed for many documents at once, each a lane of one array. A logistic curve over the log-odds
of the largest marginal and the log of the expected number of toxic tokens, fitted on the sample, makes them a score.

Edge cases: null and empty texts score as a document without toxic tokens; without labels (or with one class only) every
score is the share of toxic labels seen, 0 if none; null labels never train; repeated label rows count once, contrary ones
both; of documents that share an id the text of least hash trains; documents without a label are scored alike; offsets are
those of the text as it is; texts over `LANE` tokens are cut into lanes with
margins of 64 tokens, behind which a two-state chain has forgotten where it began; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fold, tidy, unit_hash

LANE, _MARGIN = 4096, 64
_TOKEN = re.compile(r"\w+")
_BATCH_CHARS = 2_000_000


@dataclass
class ToxicityModel:
    #: Log-odds weight of the current token's features, by word and by beginning of four and five letters; of its neighbours' words.
    word: dict[str, float] = field(default_factory=dict)
    four: dict[str, float] = field(default_factory=dict)
    five: dict[str, float] = field(default_factory=dict)
    beside: dict[str, float] = field(default_factory=dict)
    bias: float = -6.0
    transition: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    curve: tuple[float, float, float] = (0.0, 0.0, -30.0)


def tokens(text: str) -> list[str]:
    """Lower-case words, one for each word of the text as it is (lower case may be longer, and would split there)."""
    low = text.lower()
    return _TOKEN.findall(low) if len(low) == len(text) else [w.lower() for w in _TOKEN.findall(text)]


class _Emissions:
    """Emission log-odds of tokens; what a word gives by itself is remembered."""

    def __init__(self, model: ToxicityModel):
        self.model, self.own = model, {}

    def __call__(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        flat = [w for t in texts for w in t]
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        own, m = self.own, self.model
        if len(own) > 500_000:
            own.clear()
        missing = set(flat) - own.keys()
        for w in missing:
            own[w] = (m.word.get(w, 0.0) + m.four.get(w[:4], 0.0) + m.five.get(w[:5], 0.0) + m.bias, m.beside.get(w, 0.0))
        both = np.fromiter((x for w in flat for x in own[w]), dtype=np.float64, count=2 * len(flat)).reshape(-1, 2)
        e, near = both[:, 0].copy(), both[:, 1]
        if len(e) > 1:
            same = np.ones(len(e), dtype=bool)
            same[(np.cumsum(sizes) - sizes)[sizes > 0]] = False  # a document's first token has no left neighbour
            e[1:] += near[:-1] * same[1:]
            e[:-1] += near[1:] * same[1:]
        return e, sizes


def _lanes(e: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places in e as lanes x steps, lane lengths, columns to keep from/to) in groups of like length."""
    pieces = []
    start = 0
    for n in sizes.tolist():
        for a in range(0, n, LANE):
            b = min(n, a + LANE)
            left, right = max(0, a - _MARGIN), min(n, b + _MARGIN)
            pieces.append((right - left, start + left, a - left, b - left))
        start += n
    pieces.sort(reverse=True)
    at = 0
    while at < len(pieces):
        end, cells = at, 0
        while end < len(pieces) and pieces[end][0] >= 0.7 * pieces[at][0] and cells < 4_000_000:
            cells += pieces[at][0]
            end += 1
        yield np.array(pieces[at:end])
        at = end


def marginals(e: np.ndarray, sizes: np.ndarray, transition: np.ndarray, pairs: np.ndarray | None = None) -> np.ndarray:
    """P(toxic) of every token by forward-backward, over lanes of documents in lockstep.

    pairs (2 x 2), if given, gets the expected number of neighbouring tokens in each two states added to it."""
    out = np.zeros(len(e))
    t = transition
    low, high = np.logaddexp, t
    for lanes in _lanes(e, sizes):
        length, start, keep, stop = lanes.T
        steps = int(length[0])
        grid = start[:, None] + np.minimum(np.arange(steps)[None, :], length[:, None] - 1)
        x = np.ascontiguousarray(e[grid].T)  # steps x lanes
        forward, backward = np.empty_like(x), np.zeros_like(x)
        a = x[0]
        forward[0] = a
        for i in range(1, steps):  # a: log-odds of the state given all up to here
            a = x[i] + low(a + high[1, 1], high[0, 1]) - low(a + high[1, 0], high[0, 0])
            forward[i] = a
        b = np.zeros(x.shape[1])
        ends = length - 1
        for i in range(steps - 2, -1, -1):  # b: log-odds that the rest gives to the state here
            v = x[i + 1] + b
            b = np.where(i < ends, low(v + high[1, 1], high[1, 0]) - low(v + high[0, 1], high[0, 0]), 0.0)
            backward[i] = b
        p = 1 / (1 + np.exp(-np.clip(forward + backward, -500, 500)))
        column = np.arange(steps)[:, None]
        mine = (column >= keep[None, :]) & (column < stop[None, :])
        out[grid.T[mine]] = p[mine]
        if pairs is not None and steps > 1:
            inner = mine[1:]  # a pair belongs to its second token; a lane's first token has none, or its margin's
            left, right = forward[:-1][inner], (x[1:] + backward[1:])[inner]
            weights = np.stack([a * left + t[a, b] + b * right for a in (0, 1) for b in (0, 1)])
            weights = np.exp(weights - weights.max(axis=0))
            pairs += (weights / weights.sum(axis=0)).sum(axis=1).reshape(2, 2)
    return out


def _summary(p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per document: log-odds of the largest marginal; log of 1 + the expected number of toxic tokens."""
    result = np.zeros((len(sizes), 2))
    result[:, 0] = -12.0
    some = sizes > 0
    if some.any():
        starts = (np.cumsum(sizes) - sizes)[some]
        top = np.clip(np.maximum.reduceat(p, starts), 6e-6, 1 - 6e-6)
        result[some, 0] = np.log(top / (1 - top))
        result[some, 1] = np.log1p(np.add.reduceat(p, starts))
    return result


def _scores(model: ToxicityModel, emit: _Emissions, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    e, sizes = emit(texts)
    p = marginals(e, sizes, model.transition) if len(e) else np.zeros(0)
    s = _summary(p, sizes)
    a, b, c = model.curve
    return 1 / (1 + np.exp(-np.clip(a * s[:, 0] + b * s[:, 1] + c, -500, 500))), p, sizes


def _evidence(toxic: list[np.ndarray], clean: list[np.ndarray], words: list[str], key, least: int, odds: float) -> set[str]:
    """Keys that stand in at least `least` toxic documents and `odds` times as often (by log-odds) as in clean ones."""
    pos, neg = Counter(), Counter()
    for into, texts in ((pos, toxic), (neg, clean)):
        for t in texts:
            into.update({key(words[k]) for k in np.unique(t).tolist()})
    p, n = len(toxic) + 1, len(clean) + 1
    return {w for w, k in pos.items() if k >= least and math.log((k + 0.5) / p) - math.log((neg[w] + 0.5) / n) >= odds}


def _by_size(texts: list[np.ndarray], labels: list[int], most: int = 500_000) -> Iterator[tuple[list[np.ndarray], list[int]]]:
    """Runs of (texts, labels) of about `most` tokens, however many or long the texts are."""
    at = 0
    while at < len(texts):
        end, held = at, 0
        while end < len(texts) and held < most:
            held += len(texts[end])
            end += 1
        yield texts[at:end], labels[at:end]
        at = end


def fit(sample: list[tuple[str, int]], prior: float | None = None, rounds: int = 40) -> ToxicityModel:
    """Fit on (text, label). prior: the share of toxic labels where the sample's own differs from it."""
    number: dict[str, int] = {}
    coded = lambda t: np.array([number.setdefault(w, len(number)) for w in tokens(t)], dtype=np.int32)
    toxic = [coded(t) for t, y in sample if y == 1]
    clean = [coded(t) for t, y in sample if y == 0]
    kinds = list(number)
    model = ToxicityModel()
    share = len(toxic) / max(1, len(toxic) + len(clean))
    if not toxic or not clean:
        model.curve = (0.0, 0.0, 30.0 if toxic else -30.0)
        return model
    least, odds = max(3, len(toxic) // 400), 2.5
    words = _evidence(toxic, clean, kinds, lambda w: w, least, odds)
    four = _evidence(toxic, clean, kinds, lambda w: w[:4], least, odds)
    five = _evidence(toxic, clean, kinds, lambda w: w[:5], least, odds)
    marked = lambda w: w in words or len(w) > 5 and w[:5] in five or len(w) > 4 and w[:4] in four
    # features: weights live in one vector; a token has its word's, its beginnings' and its neighbours' where they are known
    times = np.bincount(np.concatenate(toxic), minlength=len(kinds))
    near = {kinds[k] for k in np.argsort(-times, kind="stable")[:2000].tolist() if times[k]} | words
    index: dict[tuple[str, str], int] = {("bias", ""): 0}
    for kind, keys in (("word", words | near), ("four", four), ("five", five), ("beside", near)):
        for k in sorted(keys):
            index[kind, k] = len(index)
    # whole texts, the longest first, in batches of like length: only the sample's rows are bounded
    texts = sorted(((t, 1 if k < len(toxic) else 0) for k, t in enumerate(toxic + clean)), key=lambda x: -len(x[0]))
    labels = [y for _, y in texts]
    texts = [t for t, _ in texts]
    none = len(index)  # the place of features that aren't known; its weight stays 0
    own = np.array([[index.get(("word", w), none), index.get(("four", w[:4]), none), index.get(("five", w[:5]), none)] for w in kinds], dtype=np.int64).reshape(-1, 3)
    beside = np.array([index.get(("beside", w), none) for w in kinds], dtype=np.int64)
    hot = np.array([marked(w) for w in kinds], dtype=bool)
    batches, seen = [], np.zeros(4)
    for part, ys in _by_size(texts, labels):
        sizes = np.array([len(t) for t in part], dtype=np.int64)
        flat = np.concatenate(part)
        g = hot[flat] & np.repeat(np.array(ys, dtype=bool), sizes)
        inner = np.ones(len(flat), dtype=bool)  # tokens that have one before them
        inner[(np.cumsum(sizes) - sizes)[sizes > 0]] = False
        pair = np.flatnonzero(inner)
        seen += np.bincount(2 * g[pair - 1] + g[pair], minlength=4)
        batches.append((flat, sizes, g, pair.astype(np.int32)))
    seen = seen.reshape(2, 2)
    # transitions start from smoothed log-frequencies
    model.transition = np.log((seen + 1) / (seen + 1).sum(axis=1, keepdims=True))
    moved = np.zeros((2, 2))
    weight, speed = np.zeros(none + 1), np.zeros(none + 1)
    for _ in range(rounds):  # gradient of the log-likelihood: gold minus marginal, by feature; Adagrad steps
        of_word, of_near = weight[own].sum(axis=1), weight[beside]
        slope, total, mine, theirs = np.zeros(none + 1), 0.0, np.zeros(len(kinds)), np.zeros(len(kinds))
        expected = np.zeros((2, 2))
        for flat, sizes, g, pair in batches:
            e = weight[0] + of_word[flat]
            e[pair] += of_near[flat[pair - 1]]
            e[pair - 1] += of_near[flat[pair]]
            error = g - marginals(e, sizes, model.transition, expected)
            total += error.sum()
            mine += np.bincount(flat, weights=error, minlength=len(kinds))
            theirs += np.bincount(flat[pair - 1], weights=error[pair], minlength=len(kinds))
            theirs += np.bincount(flat[pair], weights=error[pair - 1], minlength=len(kinds))
        for k in range(3):
            slope += np.bincount(own[:, k], weights=mine, minlength=none + 1)
        slope += np.bincount(beside, weights=theirs, minlength=none + 1) - 0.05 * weight
        slope[0], slope[none] = total, 0.0
        speed += slope * slope
        weight += slope / np.sqrt(speed + 1e-9) * 1.0
        turn = seen - expected - 0.05 * model.transition
        moved += turn * turn
        model.transition = model.transition + 0.2 * turn / np.sqrt(moved + 1e-9)
    for (kind, k), i in index.items():
        if kind == "bias":
            model.bias = float(weight[i])
        else:
            getattr(model, kind)[k] = float(weight[i])
    emit = _Emissions(model)
    x = []
    for part, _ in _by_size(texts, labels):
        e, z = emit([[kinds[k] for k in t.tolist()] for t in part])
        x.append(_summary(marginals(e, z, model.transition) if len(e) else np.zeros(0), z))
    x, y = np.concatenate(x), np.array(labels, dtype=float)
    design = np.column_stack((x, np.ones(len(x))))
    curve = np.array([0.0, 0.0, math.log(share / (1 - share))])
    for _ in range(30):  # Newton steps for the logistic curve
        p = 1 / (1 + np.exp(-np.clip(design @ curve, -30, 30)))
        h = design.T @ (design * (p * (1 - p))[:, None]) + 1e-3 * np.eye(3)
        curve = curve + np.linalg.solve(h, design.T @ (y - p) - 1e-3 * curve)
    if prior and prior < 1:  # the sample takes more of the rarer label than there is
        curve[2] += math.log(prior / (1 - prior)) - math.log(share / (1 - share))
    model.curve = tuple(float(c) for c in curve)
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int = 1500) -> tuple[list[tuple[str, int]], float]:
    """(text, label) of at most about per_class labelled training documents of each label, chosen by hash; the
    share of toxic ones among all training labels."""
    known = labels.where(F.col("toxic").isin(0, 1)).where(fold() != 2).select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null").distinct()
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if not sizes:
        return [], 0.0
    part = F.create_map(*(x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, per_class / n)))))
    chosen = known.where(unit_hash(F.col("doc_id"), seed=31) < part[F.col("toxic")])
    # a few thousand ids by construction, whatever the corpus; one text of each
    met = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = met.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")).collect()
    share = sizes.get(1, 0) / sum(sizes.values())
    return [(r["text"], r["toxic"]) for r in sorted(rows, key=lambda r: (str(r["doc_id"]), r["toxic"]))], share


def tag_toxic(docs: DataFrame, model: ToxicityModel, span_threshold: float = 0.5) -> DataFrame:
    """docs (doc_id, text) -> doc_id, score, spans (start, end code points and probability of tokens at or over the threshold)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emit = _Emissions(shared.value)
        for b in batches:
            at = 0
            while at < b.num_rows:
                raw, held, end = [], 0, at
                while end < b.num_rows and held < _BATCH_CHARS:
                    raw.append(b.column(1)[end].as_py() or "")
                    held += len(raw[-1])
                    end += 1
                score, p, sizes = _scores(shared.value, emit, [tokens(t) for t in raw])
                spans = [[] for _ in raw]
                hot = np.flatnonzero(p >= span_threshold)
                if len(hot):
                    ends = np.cumsum(sizes)
                    for i in np.unique(np.searchsorted(ends, hot, side="right")).tolist():
                        mine = p[ends[i] - sizes[i] : ends[i]]
                        places = [m.span() for m in _TOKEN.finditer(raw[i])]
                        spans[i] = [{"start": s, "end": e, "p": float(q)} for (s, e), q in zip(places, mine, strict=True) if q >= span_threshold]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, end - at), pa.array(np.round(score, 9), pa.float64()), pa.array(spans, span_type)], ["doc_id", "score", "spans"])
                at = end

    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, score double, spans array<struct<start:int,end:int,p:double>>")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(*labelled_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    tagged = tag_toxic(docs, model)
    return tagged.select("doc_id", (fold() == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), F.size("spans").cast("long").alias("n_toxic_tokens"))
