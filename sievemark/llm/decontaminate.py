"""Operator 7: benchmark decontamination by canonical templates (native DataFrame operations only).

Texts and benchmark items become token sequences in which numbers, units behind numbers and names (capitalised words
inside a sentence, or common given names anywhere) are typed placeholders; all else is lower case. Items with equal
tokens and equally repeated slot values are one template. Every run of `window` canonical tokens is hashed.

1. Documents' windows meet the benchmark's distinct windows in a hash join: broadcast where there are few enough (counted
   first), else shuffled. Equal texts are one text, told by 128 bits of hash.
2. Windows of a text that follow one another make a run. A window meets a template's windows only if its run is as long as
   some run must be in any match of that template, so a phrase that many items share leads nowhere by itself.
3. Hits of one alignment (same offset between text and template) hold only if their slots agree: a value of the template
   always stands against the same value of the text, and the other way round. A document is contaminated by an item if one
   consistent alignment covers `share` of the item's windows, or `words` consecutive words' worth of them.

Edge cases: null and empty texts match nothing; documents and items with a null id are like others (a null item is listed
as `null`); items of fewer tokens than a window are found only where they are a document's whole text, as fewer words
tell no leak from common language; repeated items are one, repeated documents share what is found; an empty benchmark or
document table gives no finding; long texts are whole; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, documents, written

#: Placeholders: private-use characters, which no text's letters include.
NUMBER, UNIT, NAME = "", "", ""
# Units of measure and common given names.
UNITS = "km|kms|m|cm|mm|mi|mile|miles|foot|feet|ft|inch|inches|kg|g|mg|lb|lbs|pound|pounds|ounce|ounces|oz|ton|tons|l|ml|liter|liters|litre|litres|gallon|gallons|second|seconds|sec|minute|minutes|min|hour|hours|hr|day|days|week|weeks|month|months|year|years|dollar|dollars|usd|euro|euros|eur|cent|cents|percent|degree|degrees|kmh|mph|watt|watts|volt|volts"
NAMES = "Alice|Bob|Carol|Dave|Eve|John|Jane|Mary|James|Robert|Michael|William|David|Richard|Joseph|Thomas|Charles|Sarah|Karen|Nancy|Lisa|Betty|Sandra|Ashley|Emily|Anna|Emma|Olivia|Sophia|Peter|Paul|Mark|George|Tom|Tim|Sam|Ben|Max|Leo|Maria|Natalia|Carlos|Luis|Juan|Hans|Pierre"


def _tokens(text: Column) -> Column:
    """The tokens of a text, cut once: a placeholder with the value that stands in it behind, or a word in lower case."""
    t = F.regexp_replace(text, f"[{NUMBER}-{NAME}]", " ")
    t = F.regexp_replace(t, r"\p{N}+(?:[.,]\p{N}+)*", f" {NUMBER}$0 ")
    t = F.regexp_replace(t, rf"({NUMBER}[^ ]+)\s*({UNITS}|[%€$£])(?!\p{{L}})", f"$1 {UNIT}$2 ")
    t = F.regexp_replace(t, rf"(?=\p{{Lu}})(?:(?<!\p{{L}})(?:{NAMES})(?!\p{{L}})|(?<=[\p{{L}},;] )\p{{Lu}}\p{{Ll}}+(?!\p{{L}}))", f"{NAME}$0")
    return F.regexp_extract_all(F.lower(t), F.lit(rf"\p{{L}}+|{NUMBER}[^ ]+|{UNIT}(?:\p{{L}}+|[%€$£])|{NAME}[\p{{L}}\p{{M}}]+"), F.lit(0))


def _kinds(tokens: Column) -> Column:
    """Canonical tokens: placeholders without their values."""
    return F.transform(tokens, lambda t: F.when(t.between(NUMBER, NAME + "\U0010ffff"), F.substring(t, 1, 1)).otherwise(t))


def _windows(tokens: Column, window: int) -> Column:
    starts = F.when(F.size(tokens) > 0, F.sequence(F.lit(1), F.greatest(F.size(tokens) - window + 1, F.lit(1))))
    return F.transform(starts, lambda i: F.xxhash64(F.slice(tokens, i, window)))


def _text_key() -> list[Column]:
    text = F.coalesce("text", F.lit(""))
    return [F.xxhash64(text).alias("h1"), F.xxhash64(text, F.lit(1)).alias("h2")]


def _is_slot(kind: Column) -> Column:
    return kind.isin(NUMBER, UNIT, NAME)


def templates(benchmark: DataFrame, window: int, share: float, words: int) -> tuple[DataFrame, DataFrame]:
    """benchmark (item_id, text) -> (template, c, p, ids), (hash, template, ipos, total, need, slots); both written.

    slots has (kind, number of the value, place in the window) of a window's placeholders; need is the least length of the
    longest run of windows in any alignment that counts as a match."""
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")).dropDuplicates()
    items = items.select("item_id", _tokens(F.col("text")).alias("v")).withColumn("c", _kinds(F.col("v")))
    number = F.zip_with("c", "v", lambda c, v: F.when(_is_slot(c), F.array_position(F.col("v"), v)).otherwise(F.lit(0)))
    items = items.select("item_id", "c", number.alias("p")).withColumn("template", F.xxhash64("c", "p"))
    made = written(items.groupBy("template").agg(F.first("c").alias("c"), F.first("p").alias("p"), F.collect_set(F.struct("item_id")).alias("ids")), "templates")
    k = F.ceil(share * F.col("total"))
    need = F.least(F.lit(words - window + 1), F.ceil(k / (F.col("total") - k + 1)))
    rows = made.withColumn("w", _windows(F.col("c"), window)).select("template", "c", "p", F.size("w").alias("total"), F.posexplode_outer("w").alias("ipos", "hash")).where("hash is not null")
    slots = F.filter(F.transform(F.slice("c", F.col("ipos") + 1, window), lambda c, i: F.struct(c.alias("kind"), F.get("p", F.col("ipos") + i).alias("value"), i.alias("place"))), lambda x: _is_slot(x["kind"]))
    return made, written(rows.select("hash", "template", "ipos", "total", need.alias("need"), slots.alias("slots")), "postings")


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 5, share: float = 0.8, words: int = 13, most_broadcast: int = 200_000) -> DataFrame:
    """docs (text), benchmark (item_id, text) -> h1, h2 (of the text), item_id, share of the item's windows; contaminated pairs
    only, written."""
    classes, postings = templates(benchmark, window, share, words)
    known = postings.groupBy("hash").agg(F.max(F.size("slots") > 0).alias("slotted"))
    few = postings.count() <= most_broadcast
    near = F.broadcast if few else lambda df: df
    tokens = docs.select(*_text_key(), _tokens(F.coalesce("text", F.lit(""))).alias("v")).withColumn("c", _kinds(F.col("v"))).withColumn("w", _windows(F.col("c"), window))
    # an outer explode: Spark would infer a filter from an inner one and compute all tokens again in it
    exploded = tokens.select("h1", "h2", "v", F.posexplode_outer("w").alias("pos", "hash"))
    values = F.slice("v", F.col("pos") + 1, window)
    if few:
        hits = exploded.join(near(known), "hash").select("h1", "h2", "pos", "hash", F.when(F.col("slotted"), values).alias("mine"))
    else:  # only windows with placeholders carry their values through the shuffle
        slim = exploded.select("h1", "h2", "pos", "hash", F.when(F.exists(values, lambda t: t.between(NUMBER, NAME + "\U0010ffff")), values).alias("mine"))
        hits = slim.join(known, "hash").drop("slotted")
    hits = hits.groupBy("h1", "h2", "pos").agg(F.first("hash").alias("hash"), F.first("mine").alias("mine"))
    run = F.col("pos") - F.row_number().over(Window.partitionBy("h1", "h2").orderBy("pos"))
    hits = hits.withColumn("run", run).withColumn("length", F.count("*").over(Window.partitionBy("h1", "h2", "run")))
    met = hits.join(near(postings), "hash").where("length >= need")
    pairs = F.transform("slots", lambda x: F.struct(x["kind"].alias("kind"), x["value"].alias("its"), F.get("mine", x["place"]).alias("docs")))
    aligned = met.select("h1", "h2", "template", "total", (F.col("pos") - F.col("ipos")).alias("shift"), "ipos", pairs.alias("pairs"))
    aligned = aligned.groupBy("h1", "h2", "template", "shift").agg(F.first("total").alias("total"), F.array_sort(F.collect_set("ipos")).alias("places"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    distinct = lambda side: F.size(F.array_distinct(F.transform("pairs", lambda p: F.struct(p["kind"], p[side]))))
    consistent = (F.size("pairs") == distinct("its")) & (F.size("pairs") == distinct("docs"))
    state = lambda last, n, best: F.struct(last.alias("last"), n.alias("n"), best.alias("best"))

    def longer(a: Column, x: Column) -> Column:
        n = F.when(x == a["last"] + 1, a["n"] + 1).otherwise(F.lit(1))
        return state(x, n, F.greatest(a["best"], n))

    longest = F.aggregate("places", state(F.lit(-2), F.lit(0), F.lit(0)), longer)["best"]
    enough = (F.size("places") >= share * F.col("total")) | (longest >= words - window + 1)
    found = aligned.where(consistent).where(enough).groupBy("h1", "h2", "template").agg(F.max(F.size("places") / F.col("total")).alias("share"))
    found = found.join(classes.select("template", "ids"), "template").select("h1", "h2", "share", F.explode("ids").alias("id"))
    found = written(found.groupBy("h1", "h2", F.col("id.item_id").alias("item_id")).agg(F.max("share").alias("share")), "matches")
    discard(classes, postings)
    return found


def contaminated(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """docs (doc_id, text), benchmark (item_id, text) -> doc_id, item_id, share of the item's windows; contaminated pairs only."""
    return docs.select("doc_id", *_text_key()).join(matches(docs, benchmark, **settings), ["h1", "h2"]).select("doc_id", "item_id", "share")


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All docs -> doc_id, contaminated, n_items, items (item ids, ascending, nulls first, comma-joined)."""
    ids = F.sort_array(F.collect_set(F.struct("item_id")))
    found = matches(docs, benchmark).groupBy("h1", "h2").agg(ids.alias("ids"))
    found = found.select("h1", "h2", F.size("ids").cast("long").alias("n_items"), F.array_join(F.transform("ids", lambda x: F.coalesce(x["item_id"].cast("string"), F.lit("null"))), ",").alias("items"))
    both = docs.select("doc_id", *_text_key()).join(found, ["h1", "h2"], "left")
    return both.select("doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", F.lit("")).alias("items"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows whose text a benchmark item contaminates."""
    found = matches(docs, benchmark).select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2")).distinct()
    h1, h2 = _text_key()
    keyed = docs.withColumn("_k1", h1).withColumn("_k2", h2)
    return keyed.join(found, (F.col("_k1") == F.col("_h1")) & (F.col("_k2") == F.col("_h2")), "left_anti").select(*docs.columns)
