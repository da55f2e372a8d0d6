"""Operator 10: mixing sources to target weights with blocks of fixed length (native DataFrame operations only).

1. Targets: sources by code point (null last) weigh `weights`, repeating; they share all words, and a target stops at
   `most` times its source's size, the excess being reshared by weight.
2. Blocks: a source's documents lie one behind another in an order by hashed chunks (prefix sums within chunks of
   bounded size, then over the chunks, so no source meets in one task) and are cut into blocks of `block_words`.
3. Shards: a source gets as many slots as its target needs. Each of them draws an output shard, so a source's counts over
   the shards are a multinomial draw whose total is pinned to the target; the counts are what is kept. A shard's slots of
   a source are numbered behind those of the shards before it.
4. A slot's number goes through its source's pseudorandom permutation of that pass over the source (swap-or-not: a
   bijection for any number of blocks), and slots join blocks by index. The short block at a source's end keeps the last
   index, and a source's last slot takes only as many words as the target still lacks, so targets are met to the word.

The result is a table of pieces (shard, slot, row, words from, to); `taken` is their sum. Everything follows from hashes of a
row's content, so the mix doesn't depend on how the table is stored or dealt out.

Edge cases: null texts have size 0 and are never taken; a null source is a source of its own, the last; sources without
words have target 0; rows equal in all columns are numbered, each a row of its own; an empty table gives an empty result;
long documents span many blocks; of columns with clashing names only those named above are read. At most `max_sources` sources
are allowed (their sizes, a few dozen bytes each, go to the driver, and one row for each is broadcast).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BLANKS, WORD, documents, written


def targets(sizes: dict[str | None, int], weights: tuple[int, ...], most: int) -> dict[str | None, float]:
    """Words that each source should give."""
    names = sorted((k for k in sizes if k is not None)) + [None] * (None in sizes)
    weight = {k: weights[i % len(weights)] for i, k in enumerate(names)}
    left, found, free = float(sum(sizes.values())), {}, [k for k in names if sizes[k]]
    while free:
        share = left / sum(weight[k] for k in free)
        over = [k for k in free if weight[k] * share > most * sizes[k]]
        if not over:
            found |= {k: weight[k] * share for k in free}
            break
        for k in over:
            found[k] = float(most * sizes[k])
            left -= found[k]
        free = [k for k in free if k not in found]
    return {k: found.get(k, 0.0) for k in names}


def permuted(index: Column, n: Column, source: Column, epoch: Column, seed: int, rounds: int = 8) -> Column:
    """A pseudorandom bijection of 0..n-1: in each round an index and its mirror image swap places or don't."""
    def step(i: Column, r: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(r, source, epoch, F.lit(seed)), n) - i, n)
        swaps = F.xxhash64(r, F.greatest(i, mirror), source, epoch, F.lit(seed + 1)).bitwiseAND(F.lit(1)) == 1
        return F.when(swaps, mirror).otherwise(i)

    return F.aggregate(F.array(*(F.lit(r) for r in range(rounds))), index, step)


def before_in(df: DataFrame, groups: list[str], order: str, value: str, wide: int) -> DataFrame:
    """df with `before`: the sum of value over the group's rows with a smaller order (a whole number, unique in its group).

    Sums run within `wide` consecutive numbers, then over those, so that a large group meets in no task."""
    dealt = df.withColumn("_far", F.floor(F.col(order) / wide))
    far = dealt.groupBy(*groups, "_far").agg(F.sum(value).alias("_sum"))
    ahead = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    far = far.select(*groups, "_far", F.coalesce(F.sum("_sum").over(ahead(Window.partitionBy(*groups).orderBy("_far"))), F.lit(0)).alias("_ahead"))
    near = dealt.withColumn("_near", F.coalesce(F.sum(value).over(ahead(Window.partitionBy(*groups, "_far").orderBy(order))), F.lit(0)))
    return near.join(far, [*groups, "_far"]).withColumn("before", F.col("_ahead") + F.col("_near")).drop("_far", "_near", "_ahead")


def _spread(df: DataFrame, first: Column, n: Column, name: str, keys: list[str], parts: int, group: int = 4096) -> DataFrame:
    """df with a row for each of n whole numbers from first, made in groups that are dealt over `parts` partitions."""
    groups = df.withColumn("_g", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / group)))).repartition(parts, *keys, "_g")
    return groups.withColumn(name, F.explode(F.sequence(first + F.col("_g") * group, first + F.least((F.col("_g") + 1) * group, n) - 1))).drop("_g")


def slot_plan(spark: SparkSession, plan: list[tuple], block_words: int, shard_slots: int, seed: int) -> DataFrame:
    """plan rows (source number, size, words to take) -> source_no, shard, slot, block, take."""
    rows, total = [], 0
    for no, size, words in plan:
        blocks, whole, rest = -(-size // block_words), words // size, words % size
        slots = whole * blocks + -(-rest // block_words)
        total += slots
        rows.append((no, size, rest, blocks, size // block_words, whole, slots))
    shards = max(1, -(-total // shard_slots))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // 2_000_000))
    table = spark.createDataFrame(rows, "source_no int, size long, rest long, blocks long, full long, passes long, slots long").where("slots > 0")
    draws = _spread(table.select("source_no", "slots"), F.lit(0).cast("long"), F.col("slots"), "draw", ["source_no"], parts)
    shard = F.pmod(F.xxhash64("source_no", "draw", F.lit(seed)), F.lit(shards)).cast("long")
    counts = draws.groupBy("source_no", shard.alias("shard")).agg(F.count("*").alias("n"))
    counts = before_in(counts, ["source_no"], "shard", "n", 4096)
    slots = _spread(counts, F.col("before"), F.col("n"), "slot", ["source_no", "shard"], parts).select("source_no", "shard", "slot")
    slots = slots.join(table, "source_no").withColumn("epoch", F.floor(F.col("slot") / F.col("blocks"))).withColumn("i", F.col("slot") % F.col("blocks"))
    block = F.when(F.col("i") < F.col("full"), permuted(F.col("i"), F.col("full"), F.col("source_no"), F.col("epoch"), seed)).otherwise(F.col("i"))
    length = F.least(F.lit(block_words).cast("long"), F.col("size") - block * block_words)
    take = F.when(F.col("epoch") < F.col("passes"), length).otherwise(F.least(length, F.col("rest") - F.col("i") * block_words))
    return slots.select("source_no", "shard", "slot", "epoch", block.alias("block"), take.alias("take"))


def numbered_rows(keyed: DataFrame) -> DataFrame:
    """keyed (k1, k2: 128 bits of a row's content, source, size) -> the same, one row for each repeat, with copy and r1, r2
    (128 bits of content and copy). Repeats are counted before they are dealt out again, so they meet in no task."""
    counted = keyed.groupBy("k1", "k2").agg(F.first("source").alias("source"), F.first("size").alias("size"), F.count("*").alias("m"))
    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = counted.where("m > 1")
    more = _spread(many, F.lit(0).cast("long"), F.col("m"), "copy", ["k1", "k2"], parts)
    rows = counted.where("m = 1").withColumn("copy", F.lit(0).cast("long")).unionByName(more)
    return rows.select("k1", "k2", "source", "size", "m", "copy", F.xxhash64("k1", "k2", "copy").alias("r1"), F.xxhash64("copy", "k2", "k1").alias("r2"))


def mix(rows: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, block_words: int = 256, shard_slots: int = 1024, seed: int = 20, max_sources: int = 1_000_000, chunk_rows: int = 2048) -> tuple[DataFrame, DataFrame]:
    """rows (r1, r2: unique together, source, size; the same at each reading) ->
    sources (source, source_no, source_size, target) and pieces (shard, slot, epoch, r1, r2, from, to; words of the row, to exclusive)."""
    spark = rows.sparkSession
    found = rows.groupBy("source").agg(F.sum("size"), F.count("*")).limit(max_sources + 1).collect()
    if len(found) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    sizes, n = {r[0]: r[1] for r in found}, sum(r[2] for r in found)
    aims = targets(sizes, weights, most)
    plan = [(i, sizes[k], min(round(t), most * sizes[k])) for i, (k, t) in enumerate(aims.items()) if sizes[k]]
    sources = spark.createDataFrame([(k, i, sizes[k], t) for i, (k, t) in enumerate(aims.items())], "source string, source_no int, source_size long, target double")
    numbers = sources.select(F.col("source").alias("s"), "source_no")

    placed = rows.where("size > 0").select("r1", "r2", "size", "source").join(F.broadcast(numbers), F.col("source").eqNullSafe(F.col("s"))).drop("s", "source")
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64("r1", F.lit(seed)), F.lit(max(1, n // chunk_rows))))
    sums = placed.groupBy("source_no", "chunk").agg(F.sum("size").alias("n"))
    sums = before_in(sums, ["source_no"], "chunk", "n", 4096).select("source_no", "chunk", F.col("before").alias("base"))
    inner = F.sum("size").over(Window.partitionBy("source_no", "chunk").orderBy("r1", "r2").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = placed.withColumn("inner", inner).join(sums, ["source_no", "chunk"]).withColumn("start", F.col("base") + F.col("inner")).withColumn("end", F.col("start") + F.col("size"))
    held = placed.select("r1", "r2", "source_no", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor((F.col("end") - 1) / block_words))).alias("block"))

    slots = slot_plan(spark, plan, block_words, shard_slots, seed)
    head = F.col("block") * block_words
    low, high = F.greatest(F.col("start"), head), F.least(F.col("end"), head + F.col("take"))
    pieces = held.join(slots.hint("merge"), ["source_no", "block"]).where(high > low)
    return sources, pieces.select("shard", "slot", "epoch", "r1", "r2", (low - F.col("start")).alias("from"), (high - F.col("start")).alias("to"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _content(docs: DataFrame) -> list[Column]:
    """128 bits of a row; maps, which have no order, as JSON."""
    columns = [F.to_json(F.struct(c)) if t.startswith("map") else F.col(c) for c, t in docs.dtypes]
    places = [F.concat_ws(",", *(F.when(F.col(c).isNull(), F.lit(str(i))) for i, c in enumerate(docs.columns)))]  # which are null
    return [F.xxhash64(*columns, *places).alias("k1"), F.xxhash64(F.lit(1), *places, *columns).alias("k2")]


def op10_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    keyed = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), *_content(docs))
    keyed = written(keyed, "sizes")
    rows = written(numbered_rows(keyed), "rows")
    ids = keyed.groupBy("k1", "k2").agg(F.first("doc_id").alias("doc_id"))
    sources, pieces = mix(rows)
    taken = pieces.groupBy("r1", "r2").agg(F.sum(F.col("to") - F.col("from")).alias("taken"))
    out = rows.join(ids, ["k1", "k2"]).join(taken, ["r1", "r2"], "left")
    facts = F.broadcast(sources.select(F.col("source").alias("s"), "source_size", "target"))
    out = out.join(facts, F.col("source").eqNullSafe(F.col("s")))
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, with_shard: bool = False) -> DataFrame:
    """The mix itself, with the columns of docs: a document appears once for each pass over its source that takes any of its
    words, with the words that the pass takes (as it is, if that is all of them). n_chars follows the text. with_shard adds
    mix_shard, the output shard in which that pass over the document begins."""
    source = F.col("source") if "source" in docs.columns else F.lit(None)
    keys = _content(docs)
    keyed = written(docs.select(*keys, source.cast("string").alias("source"), word_count(F.col("text")).alias("size")), "mix-sizes")
    rows = written(numbered_rows(keyed), "mix-rows")
    _, pieces = mix(rows)
    span = F.struct("from", "to", "shard")
    passes = pieces.groupBy("r1", "r2", "epoch").agg(F.array_sort(F.collect_list(span)).alias("spans"), F.sum(F.col("to") - F.col("from")).alias("n"))
    passes = passes.join(rows.select("r1", "r2", "k1", "k2", "size"), ["r1", "r2"])
    whole = F.col("n") == F.col("size")
    passes = passes.select("k1", "k2", F.struct(F.col("spans")[0]["shard"].alias("shard"), F.when(~whole, F.transform("spans", lambda x: F.struct(x["from"].alias("from"), x["to"].alias("to")))).alias("ranges")).alias("one"))
    # a document's passes are as many as its repeats times `most` at most; repeats are dealt out in the join
    hashed = docs.select(*keys, *(F.col(c).alias(f"_{i}") for i, c in enumerate(docs.columns)))
    if not rows.where("m > 1").isEmpty():
        hashed = hashed.dropDuplicates(["k1", "k2"])
    mixed = hashed.join(passes, ["k1", "k2"])
    text = F.col(f"_{docs.columns.index('text')}")
    words = F.filter(F.split(text, BLANKS), lambda w: w != "")
    some = F.array_join(F.flatten(F.transform("one.ranges", lambda r: F.slice(words, (r["from"] + 1).cast("int"), (r["to"] - r["from"]).cast("int")))), " ")
    mixed = mixed.withColumn("_text", F.when(F.col("one.ranges").isNull(), text).otherwise(some))
    changed = {"text": F.col("_text")} | ({"n_chars": F.length("_text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    out = [changed.get(c, F.col(f"_{i}")).alias(c) for i, c in enumerate(docs.columns)]
    return mixed.select(*out, *([F.col("one.shard").alias("mix_shard")] if with_shard else []))
