"""Operator 2: personal data by fixed rules plus bootstrapped contextual extraction.

One pass over the texts finds the base spans (e-mail, address, card, phone) and, beside them, candidate tokens:
tokens with a digit or at-sign that no base span touches. Seeds are the base spans and, among the candidates, keys: long
tokens that mix letters and digits as no word does. Every seed and candidate is an instance, and the words around it are
its lexical patterns; both go as hashes into a pattern-instance graph. Spark scores that graph iteratively: a pattern's
confidence is the smoothed share of its distinct instances that are believed, an instance is believed as much as its
best pattern (seeds: fully). Candidates of patterns that end above the confidence threshold, with enough distinct seeds,
become spans of kind `context`; a key that no such pattern surrounds is none. The graph is aggregated before it is
shuffled, patterns and instances with very many edges meet theirs as a broadcast of counted size, and each round is a
written table; accepted patterns meet candidates in an equi-join, never on the driver.

Edge cases: null texts are empty texts; empty tables give empty results; repeated rows give repeated results and
count once in the graph; all rules are linear in the text's length, so very long texts are whole, with or without blanks;
of ties all patterns count; a base match that fails its check is dropped and the search goes on behind it; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shuffles import skew_join
from .common import discard, documents, tidy, written

#: Kinds in the order in which spans with equal starts are listed.
KINDS = ("email", "ip", "card", "phone", "context")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits is entered at its first digit only: a search that starts inside one finds nothing else.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: What ends a token, beside white space; a token that may be an identifier, from its first digit or at-sign on.
_ENDS = frozenset("\"'<>()[]{},;=:")
_FROM_MARK = re.compile(r"[0-9@][^\s\"'<>()\[\]{},;=:]*")
_KEY = re.compile(r"(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9_+/-]+")
_SIDE = re.compile(r"[^\W\d_]+|\d+|[^\w\s]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local@domain.tld; every at-sign is looked at once."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = floor + len(text[floor:at].rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        # behind a failed sign the next local part may start at once
        floor = m.end() if m else at + 1
        at = text.find("@", floor)


def _octets(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))


def _luhn(s: str) -> bool:
    digits = s.replace(" ", "").replace("-", "")
    if not 12 <= len(digits) <= 19:
        return False
    total = sum(map(int, digits[-1::-2])) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def _digits(s: str) -> bool:
    return 9 <= sum(c.isdigit() for c in s) <= 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), by start and kind."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    for kind, pattern, holds in ((1, _IP, _octets), (2, _CARD, _luhn)):
        out += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if holds(m.group())]
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if _digits(m.group())]
    return sorted(out)


def _hash(s: str) -> int:
    return xxhash.xxh3_64_intdigest(s.encode("utf-8", "surrogatepass")) - (1 << 63)


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """Tokens with a digit or at-sign. Every character is looked at once, however long a token is."""
    floor = 0
    for m in _FROM_MARK.finditer(text):
        start = m.start()
        while start > floor and not (text[start - 1] in _ENDS or text[start - 1].isspace()):
            start -= 1
        floor = m.end()
        yield start, floor


def _patterns(text: str, start: int, end: int, reach: int) -> list[int]:
    """Hashes of the lexical patterns around a span: two tokens before it; one before and one behind it. Tokens are looked for
    within `reach` characters on each side; what is cut off there is no token."""
    side = lambda s: ["0" if x[0].isdigit() else x.lower() for x in _SIDE.findall(s)]
    low, high = max(0, start - reach), min(len(text), end + reach)
    before, behind = text[low:start], text[end:high]
    left, right = side(before), side(behind)
    if low and left and before[0].isalnum() and text[low - 1].isalnum():
        left = left[1:]
    if high < len(text) and len(right) == 1 and behind[-1].isalnum() and text[high].isalnum():
        right = []
    left, right, out = left[-2:], right[:1], []
    if len(left) == 2:
        out.append(_hash(f"L {left[0]} {left[1]}"))
    if left and right:
        out.append(_hash(f"B {left[-1]} _ {right[0]}"))
    return out


def _marks(text: str, spans: list[tuple[int, int, int]], least_candidate: int, least_key: int, reach: int) -> list[tuple]:
    """(start, end, instance, seed, base, patterns) of the base spans and of the candidates that touch none."""
    out = [(s, e, _hash(text[s:e].lower()), True, True, _patterns(text, s, e, reach)) for s, _, e in spans]
    if not any(c in text for c in "0123456789@"):
        return out
    taken = iter(sorted((s, e) for s, _, e in spans))
    low, high = next(taken, (len(text) + 1, 0))
    for s, e in candidates(text):
        while high and high <= s:
            low, high = next(taken, (len(text) + 1, 0))
        if e - s >= least_candidate and e <= low:
            token = text[s:e]
            key = least_key <= e - s <= 512 and _KEY.fullmatch(token) is not None
            out.append((s, e, _hash(token.lower()), key, False, _patterns(text, s, e, reach)))
    return out


def _scan(docs: DataFrame, least_candidate: int, least_key: int, reach: int) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    marks_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("instance", pa.int64()), ("seed", pa.bool_()), ("base", pa.bool_()), ("patterns", pa.list_(pa.int64()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            all_spans, all_marks, sha, counts = [], [], [], [[] for _ in range(4)]
            for text in b.column(1).to_pylist():
                text = text or ""
                spans = base_spans(text)
                marks = _marks(text, spans, least_candidate, least_key, reach)
                all_spans.append([{"start": s, "kind": k, "end": e} for s, k, e in spans])
                all_marks.append([dict(zip(("start", "end", "instance", "seed", "base", "patterns"), x, strict=True)) for x in marks])
                sha.append(hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest())
                for k in range(4):
                    counts[k].append(sum(x[1] == k for x in spans))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(sha, pa.string()), pa.array(all_spans, spans_type), pa.array(all_marks, marks_type)], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "marks"])

    schema = f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base array<struct<start:int,kind:int,end:int>>, marks array<struct<start:int,end:int,instance:bigint,seed:boolean,base:boolean,patterns:array<bigint>>>"
    return docs.select("doc_id", "text").mapInArrow(tidy(run), schema)


def pattern_scores(edges: DataFrame, rounds: int = 3, smoothing: float = 1.0) -> DataFrame:
    """edges (pattern, instance, seed, times), distinct by the first two -> pattern, confidence, seeds, edges, times.

    Each round: patterns from the instances' beliefs, then the beliefs from the best pattern."""
    seed = F.col("seed").cast("double")
    belief = written(edges.groupBy("instance").agg(F.max(seed).alias("belief"), F.count("*").alias("edges")), "belief")
    scored = None
    for i in range(rounds):
        met = skew_join(edges, belief, ["instance"], "edges")
        now = written(met.groupBy("pattern").agg((F.sum("belief") / (F.count("*") + smoothing)).alias("confidence"), F.sum(F.col("seed").cast("long")).alias("seeds"), F.count("*").alias("edges"), F.sum("times").alias("times")), "patterns")
        discard(belief, *([scored] if scored is not None else []))
        scored = now
        if i + 1 < rounds:
            met = skew_join(edges, scored.select("pattern", "confidence", "edges"), ["pattern"], "edges")
            belief = written(met.groupBy("instance").agg(F.greatest(F.max(seed), F.max("confidence")).alias("belief"), F.count("*").alias("edges")), "belief")
    return scored


def find_personal_data(docs: DataFrame, confidence: float = 0.8, least_seeds: int = 4, rounds: int = 3, least_candidate: int = 6, least_key: int = 20, reach: int = 64) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_context, n_spans.

    n_* and base_sha256 tell the base spans; spans joins all of them as kind:start:end (code points, end exclusive).
    least_candidate and least_key are the least lengths of candidates and of keys, reach is how far (in characters) a
    pattern's tokens may lie from the span."""
    found = written(_scan(docs, least_candidate, least_key, reach).withColumn("row", F.monotonically_increasing_id()), "spans")
    marks = found.select("row", F.explode("marks").alias("m")).select("row", "m.*")
    edges = marks.select("instance", "seed", F.explode("patterns").alias("pattern")).groupBy("pattern", "instance").agg(F.max("seed").alias("seed"), F.count("*").alias("times"))
    edges = written(edges, "edges")
    scored = pattern_scores(edges, rounds)
    good = scored.where((F.col("confidence") >= confidence) & (F.col("seeds") >= least_seeds)).select("pattern", "times")
    new = marks.where("not base").select("row", "start", "end", F.explode("patterns").alias("pattern"))
    new = skew_join(new, good, ["pattern"], "times")
    extra = new.groupBy("row", "start", "end").agg(F.lit(1).alias("one")).groupBy("row").agg(F.collect_list(F.struct("start", F.lit(4).alias("kind"), "end")).alias("extra"))
    extra = written(extra, "extra")
    discard(edges, scored)
    kinds = F.array(*map(F.lit, KINDS))
    every = F.array_sort(F.concat("base", F.coalesce("extra", F.array().cast("array<struct<start:int,kind:int,end:int>>"))))
    spans = F.array_join(F.transform(every, lambda x: F.concat_ws(":", kinds[x["kind"]], x["start"].cast("string"), x["end"].cast("string"))), ",")
    n = F.coalesce(F.size("extra"), F.lit(0)).cast("long")
    return found.drop("marks").join(extra, "row", "left").select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", spans.alias("spans"), n.alias("n_context"), (n + F.size("base")).alias("n_spans"))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(documents(spark, sf_dir))
