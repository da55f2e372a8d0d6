"""Operator 4: document fingerprints by consistent weighted sampling (native DataFrame operations only).

A document's terms are its words, weighted 1 + ln(count). For each of `samples` samples a term gets, from hashes of
itself and the sample's number alone, r and c ~ Gamma(2, 1) and b ~ U(0, 1); with t = floor(ln(weight) / r + b) its value is
ln c - r (t - b) - r, and the sample is the (term, t) of the least value (improved consistent weighted sampling). Two
documents agree in a sample with the probability of their generalised Jaccard similarity. Value and (term, t) share one
integer, so that a sample is a plain minimum; a fingerprint lists 16 hashed bits of each sample in hex.

Every row needs its successor by doc_id: rows of ids and hashes alone are range-partitioned and numbered by part, the
successor comes from a window over each part, and a part's last row takes the first of the next part (one row a part).
A document's text then meets the beginning of the next text in an equi-join on the row's key; all grouping by document
reuses that partitioning.

Edge cases: null texts are empty; a text without words has the fingerprint of one empty term, so empty texts are alike; rows of
equal doc_id follow one another by the hash of their text, and repeated rows are each other's successors; a single
document is its own successor; an empty table gives an empty result; long texts are whole; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BLANKS, documents, written

_LOW32 = 0xFFFFFFFF
_KEY = ("doc_id", "h")


def _sample(term: Column, log_weight: Column, k: int) -> Column:
    """The k-th sample's value and identity of a term as one long."""
    a, b = F.xxhash64(term, F.lit(2 * k)), F.xxhash64(term, F.lit(2 * k + 1))
    unit = lambda h, shift, bits: ((F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << bits) - 1)).cast("double")) + 0.5) / float(1 << bits)
    r = -F.ln(unit(a, 0, 21) * unit(a, 21, 21))
    c = -F.ln(unit(b, 0, 32) * unit(b, 32, 32))
    beta = unit(a, 42, 22)
    t = F.floor(log_weight / r + beta)
    value = F.ln(c) - r * (t - beta) - r
    place = F.floor(value * float(1 << 22))
    return F.shiftleft(place, 32).bitwiseOR(F.xxhash64(term, t, F.lit(k)).bitwiseAND(F.lit(_LOW32)))


#: Hexadecimal digits of a digest that one long carries, and how many longs a digest takes.
_DIGITS, _PIECES = 13, 5


def sketches(texts: DataFrame, keys: list[str], samples: int) -> DataFrame:
    """texts (keys, version, text, sha) -> keys, version, fingerprint, sha.

    Where rows are partitioned by keys, nothing is shuffled. A digest travels behind the words, as rows of its own."""
    pieces = F.transform(F.sequence(F.lit(0), F.lit(_PIECES - 1)), lambda j: F.substring(F.col("sha"), j * _DIGITS + 1, F.lit(_DIGITS)))
    parts = texts.select(*keys, "version", F.split("text", BLANKS).alias("words"), F.when(F.col("sha").isNull(), F.array().cast("array<string>")).otherwise(pieces).alias("pieces"))
    rows = parts.select(*keys, "version", F.size("words").alias("n"), F.posexplode_outer(F.concat("words", "pieces")).alias("pos", "word"))
    piece = F.col("pos") >= F.col("n")
    term = F.when(piece, F.conv("word", 16, 10).cast("long")).otherwise(F.xxhash64("word"))
    rows = rows.select(*keys, "version", F.when(piece, F.col("pos") - F.col("n") + 1).otherwise(0).alias("piece"), term.alias("term"), (F.col("word") != "").cast("int").alias("real"))
    counted = rows.groupBy(*keys, "version", "piece", "term").agg(F.count("*").alias("n"), F.max("real").alias("real"))
    weight = F.when(F.col("real") == 1, F.log1p(F.log(F.col("n").cast("double")))).otherwise(F.lit(-40.0))
    weighted = counted.select(*keys, "version", "piece", "term", weight.alias("lw"))
    least = [F.min(F.when(F.col("piece") == 0, _sample(F.col("term"), F.col("lw"), k))).alias(f"s{k}") for k in range(samples)]
    digest = [F.max(F.when(F.col("piece") == j + 1, F.col("term"))).alias(f"d{j}") for j in range(_PIECES)]
    grouped = weighted.groupBy(*keys, "version").agg(*least, *digest)
    digits = F.concat(*(F.lpad(F.lower(F.hex(F.col(f"s{k}").bitwiseAND(F.lit(0xFFFF)))), 4, "0") for k in range(samples)))
    widths = [min(_DIGITS, 64 - j * _DIGITS) for j in range(_PIECES)]
    sha = F.concat(*(F.lpad(F.lower(F.hex(f"d{j}")), w, "0") for j, w in enumerate(widths)))
    return grouped.select(*keys, "version", digits.alias("fingerprint"), sha.alias("sha"))


def likeness(a: Column, b: Column, samples: int) -> Column:
    """Share of the samples in which two fingerprints agree."""
    same = F.lit(0)
    for k in range(samples):
        same = same + (F.substring(a, 4 * k + 1, 4) == F.substring(b, 4 * k + 1, 4)).cast("int")
    return same / float(samples)


def _successors(ids: DataFrame) -> DataFrame:
    """Distinct (doc_id, h) with n_chars and m rows -> each with its successor and predecessor, around the end."""
    keyed = written(ids.groupBy(*_KEY).agg(F.first("n_chars").alias("n_chars"), F.count("*").alias("m")).repartitionByRange(*_KEY).withColumn("part", F.spark_partition_id()), "order")
    here = F.struct("doc_id", "h", "n_chars")
    w = Window.partitionBy("part").orderBy(*_KEY)
    inner = keyed.select("*", F.lead(here).over(w).alias("next"), F.lag(here).over(w).alias("prev"))
    ends = keyed.groupBy("part").agg(F.min(here).alias("first"), F.max(here).alias("last"))
    parts = Window.orderBy("part")  # one row for each range partition
    all_parts = parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("part", F.coalesce(F.lead("first").over(parts), F.first("first").over(all_parts)).alias("after"), F.coalesce(F.lag("last").over(parts), F.last("last").over(all_parts)).alias("before"))
    both = inner.join(F.broadcast(ends), "part")
    return both.select(*_KEY, "n_chars", "m", F.coalesce("next", "after").alias("next"), F.coalesce("prev", "before").alias("prev"))


def fingerprint_documents(docs: DataFrame, samples: int = 32, edited_share: float = 0.25) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = docs.sparkSession
    # a null doc_id is a key like others: it is told apart by the hash
    h = F.xxhash64("text", F.col("doc_id").isNull())
    filler = F.lit("") if docs.schema["doc_id"].dataType.simpleString() == "string" else F.lit(0)
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", h)
    order = written(_successors(base.select("doc_id", "h", F.length("text").alias("n_chars"))), "successors")
    key = lambda row, i, z: (F.coalesce(row["doc_id"], filler).alias(i), row["h"].alias(z))
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    # this exchange is the texts' only one; both uses below read it
    rows = base.select(*key(F.struct("doc_id", "h"), "i", "z"), "text").repartition(parts, "i", "z").dropDuplicates(["i", "z"])
    facts = order.select(*key(F.struct("doc_id", "h"), "i", "z"), "m", *key(F.col("prev"), "pi", "pz"), F.col("prev.n_chars").alias("pn"))
    sent = rows.join(facts.select("i", "z", "pi", "pz", "pn").hint("merge"), ["i", "z"]).select(F.col("pi").alias("i"), F.col("pz").alias("z"), F.substring(F.col("text"), F.lit(1), F.floor(F.col("pn") * edited_share).cast("int")).alias("begin"))
    met = rows.join(facts.select("i", "z", "m").hint("merge"), ["i", "z"]).join(sent.repartition(parts, "i", "z").hint("merge"), ["i", "z"])
    cut = F.floor(F.length("text") * edited_share).cast("int")
    kept = F.substring(F.col("text"), F.lit(1), F.length("text") - cut)
    # of m repeated rows the first m - 1 are followed by a copy of themselves (version 2), the last by the next text (1)
    edited = met.select("i", "z", "text", "m", F.concat(kept, F.col("begin")).alias("edited"), F.concat(kept, F.substring(F.col("text"), F.lit(1), cut)).alias("own"))
    version = lambda v, text, sha: F.struct(F.lit(v).alias("version"), text.alias("text"), sha.alias("sha"))
    none = F.lit(None).cast("string")
    three = F.array(version(0, F.col("text"), none), version(1, F.col("edited"), F.sha2("edited", 256)), F.when(F.col("m") > 1, version(2, F.col("own"), F.sha2("own", 256))))
    texts = edited.select("i", "z", F.explode_outer(three).alias("v")).select("i", "z", "v.*").where("version is not null")
    marks = written(sketches(texts, ["i", "z"], samples), "fingerprints")
    own = marks.where("version = 0")
    out = order.select("doc_id", *key(F.struct("doc_id", "h"), "i", "z"), "n_chars", "m", *key(F.col("next"), "ni", "nz"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))).alias("copy"))
    out = out.withColumn("version", F.when(F.col("copy") < F.col("m"), 2).otherwise(1))
    out = out.join(own.select("i", "z", "fingerprint"), ["i", "z"]).join(marks.select("i", "z", "version", F.col("fingerprint").alias("edited_fingerprint"), F.col("sha").alias("edited_sha256")), ["i", "z", "version"])
    out = out.join(own.select(F.col("i").alias("ni"), F.col("z").alias("nz"), F.col("fingerprint").alias("next_fingerprint")), ["ni", "nz"])
    near_next = F.when(F.col("copy") < F.col("m"), F.lit(1.0)).otherwise(likeness(F.col("fingerprint"), F.col("next_fingerprint"), samples))
    return out.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint"), samples).alias("near_edited"), near_next.alias("near_next"))


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(documents(spark, sf_dir))
