"""Operator 5: n-gram Jaccard self-join by chosen paths.

Sets are the distinct shingles of `words` words (a text of fewer words is one shingle). Equal sets are one node, whose
documents are counted, never paired. For each node a MinHash signature is kept; then

1. Chosen paths: in every run a node enters the bucket of one sampled signature place (a shared token of its set). Buckets
   over `limit` are split again by further places, chosen from the path's hash, two children at a time, up to `depth`
   times. Buckets with the same members are kept once. `runs` follows from the target recall: a pair at the threshold
   misses all runs with a probability of at most 1 - recall.
2. Brute force: within a small bucket all signatures are compared; what may reach the threshold (six standard errors below
   it) is linked by a spanning forest. Larger buckets left at the last depth are compared in blocks of `limit`.
3. The forest's components are candidate groups. In each, the full shingle sets are compared exactly, in blocks of about
   `block` nodes or `block_shingles` shingles; a task gives each node's number of linked documents and a forest of the true links, never the pairs.
4. Classes are the components of the true links.

Edge cases: null texts and texts without words have no set and link to nothing; repeated rows are copies like others; an
empty table gives an empty result; class ids are the smallest doc_id of the class (nulls count as smallest only among
themselves); long texts are whole; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, discard, documents, tidy, written
from .substring_dedup import Hashed, _batches, _mixed

PLACES = 64
_ODD = np.array([_x | 1 for _x in np.random.default_rng(5).integers(1 << 62, 1 << 63, PLACES)], dtype=np.uint64)
_SALT = np.random.default_rng(6).integers(1 << 62, 1 << 63, PLACES).astype(np.uint64)


def shingle_sets(texts: list[list[bytes]], words: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of all texts, sorted within each; how many each has)."""
    h = Hashed(texts)
    out, sizes = [], []
    at = np.arange(max(0, len(h.words) - words + 1))
    grams = h.stretch(at, at + words, 7)
    for end, n in zip(h.ends.tolist(), h.sizes.tolist(), strict=True):
        if n >= words:
            mine = np.unique(grams[end - n : end - words + 1])
        elif n:
            mine = h.stretch(np.array([end - n]), np.array([end]), 7 + n)
        else:
            mine = grams[:0]
        out.append(mine)
        sizes.append(len(mine))
    return (np.concatenate(out) if out else grams[:0]), np.array(sizes, dtype=np.int64)


def _signed(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, text, th -> doc_id, th, node (16 bytes of the set; null: none), n (its size), sig (PLACES x 4 bytes)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in _batches(b.column(1).to_pylist()):
                flat, sizes = shingle_sets(texts, words)
                real = np.flatnonzero(sizes)
                node, sig = [None] * len(sizes), [None] * len(sizes)
                if len(real):
                    starts = (np.cumsum(sizes) - sizes)[real]
                    halves = [np.add.reduceat(_mixed(flat + np.uint64(k)), starts) for k in (1, 2)]
                    ids = np.ascontiguousarray(np.stack(halves, axis=1)).view("V16").ravel()
                    least = np.stack([np.minimum.reduceat(((flat ^ s) * o) >> np.uint64(32), starts).astype(np.uint32) for s, o in zip(_SALT, _ODD, strict=True)], axis=1)
                    for k, i in enumerate(real.tolist()):
                        node[i], sig[i] = ids[k].tobytes(), least[k].tobytes()
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(sizes)), b.column(2).slice(at, len(sizes)), pa.array(node, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sig, pa.binary())], ["doc_id", "th", "node", "n", "sig"])

    return docs.select("doc_id", "text", "th").mapInArrow(tidy(run), f"doc_id {kind}, th long, node binary, n long, sig binary")


def runs_for(recall: float, threshold: float, depth: int) -> int:
    """Runs after which a pair at the threshold is missed with a probability of at most 1 - recall."""
    one = threshold * (1 - (1 - threshold) ** 2) ** depth
    return math.ceil(math.log(1 - recall) / math.log(1 - one))


def _place(sig, place):
    """The signature's value at a place, as bytes."""
    return F.substring(sig, place * 4 + 1, F.lit(4))


def _buckets(nodes: DataFrame, runs: int, depth: int, limit: int) -> DataFrame:
    """nodes (node, sig) -> path, node, size of the buckets to compare; written."""
    first = nodes.select("node", F.explode(F.transform(F.sequence(F.lit(0), F.lit(runs - 1)), lambda r: F.xxhash64(r, F.substring("sig", F.pmod(r * 7, F.lit(PLACES)) * 4 + 1, F.lit(4))))).alias("path"))
    paths, done, tables = written(first, "paths"), None, []
    for level in range(depth + 1):
        sizes = paths.groupBy("path").agg(F.count("*").alias("size"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("members")).where("size > 1")
        sizes = written(sizes.groupBy("size", "members").agg(F.min("path").alias("path")).select("path", "size"), "sizes")
        tables += [paths, sizes]
        last = level == depth
        small = sizes if last else sizes.where(F.col("size") <= limit)
        found = paths.join(small, "path")
        done = found if done is None else done.union(found)
        large = sizes.where(F.col("size") > limit)
        if last or large.isEmpty():
            break
        child = lambda k: F.struct(F.pmod(F.xxhash64("path", F.lit(k)), F.lit(PLACES // 2)).cast("int") * 2 + k)
        split = paths.join(large, "path").join(nodes, "node").select("node", "path", "sig", F.explode(F.array(child(0), child(1))).alias("p"))
        paths = written(split.select("node", F.xxhash64("path", "p.col1", F.substring(F.col("sig"), F.col("p.col1") * 4 + 1, F.lit(4))).alias("path")), "paths")
    done = written(done, "buckets")
    discard(*tables)
    return done


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[list]]]:
    """Groups of rows with equal first columns, from batches sorted by them."""
    now, held = None, None
    for b in batches:
        columns = [c.to_pylist() for c in b.columns]
        heads = list(zip(*columns[:keys], strict=True))
        at = 0
        while at < len(heads):
            end = at
            while end < len(heads) and heads[end] == heads[at]:
                end += 1
            if heads[at] != now:
                if held is not None:
                    yield now, held
                now, held = heads[at], [[] for _ in columns[keys:]]
            for into, c in zip(held, columns[keys:], strict=True):
                into += c[at:end]
            at = end
    if held is not None:
        yield now, held


def _forest(m: int, near) -> list[tuple[int, int]]:
    """A spanning forest of a graph over 0..m-1; near(i, rest) tells which of rest are i's neighbours."""
    rest, edges = np.arange(m), []
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            hit = near(i, rest)
            if hit.any():
                new = rest[hit].tolist()
                edges += [(i, j) for j in new]
                queue += new
                rest = rest[~hit]
    return edges


def _blocked(df: DataFrame, blocks: Column) -> DataFrame:
    """Deal a group's rows into blocks and each row to all pairs of blocks with its own: adds i, j, mine."""
    own = F.pmod(F.xxhash64("node", F.lit(3)), blocks).cast("int")
    with_own = df.withColumn("mine", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return with_own.withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other")).drop("other")


def _candidates(buckets: DataFrame, nodes: DataFrame, limit: int, threshold: float) -> DataFrame:
    """Spanning forests (a, b) of the nodes in a bucket whose signatures may reach the threshold."""
    least = threshold - 6 * math.sqrt(threshold * (1 - threshold) / PLACES)
    dealt = _blocked(buckets, F.ceil(F.col("size") / limit).cast("int")).join(nodes, "node").select("path", "i", "j", "node", "n", "sig")
    dealt = dealt.repartition("path", "i", "j").sortWithinPartitions("path", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for _, (node, n, sig) in _grouped(batches, 3):
            sigs, n = np.frombuffer(b"".join(sig), np.uint32).reshape(len(sig), PLACES), np.array(n)

            def near(i, rest):
                return ((sigs[rest] == sigs[i]).mean(axis=1) >= least) & (np.minimum(n[rest], n[i]) >= threshold * np.maximum(n[rest], n[i]) - 1e-9)

            for x, y in _forest(len(node), near):
                a.append(node[x])
                b.append(node[y])
            if len(a) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return dealt.mapInArrow(tidy(run), "a binary, b binary").distinct()


def _overlaps(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Postings of the sets' shingles: (shingle number of each entry, entry offsets of the sets, owners by shingle, offsets)."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    _, number = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(number, kind="stable")
    return number, np.concatenate(([0], np.cumsum(sizes))), owner[order], np.concatenate(([0], np.cumsum(np.bincount(number))))


def _exact(groups: DataFrame, percent: int) -> DataFrame:
    """groups sorted by (component, i, j): exact comparison in a block pair -> node, other (forest edge; null: a count),
    label (the least node of its class, where the whole component is in one block), links."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for (_, i, j), (blocks, node, copies, mine, sets) in _grouped(batches, 3):
            once = list({x: k for k, x in enumerate(node)}.values())
            node, sets = [node[k] for k in once], [np.frombuffer(sets[k], np.uint64) for k in once]
            mine, copies = np.array(mine)[once], np.array(copies)[once]
            number, cuts, owners, offsets = _overlaps(sets)
            sizes = np.diff(cuts)
            m, links = len(sets), [0] * len(sets)
            near = np.zeros((m, m), dtype=bool)
            for k in range(m):
                own = number[cuts[k] : cuts[k + 1]]
                lengths = offsets[own + 1] - offsets[own]
                at = np.repeat(offsets[own] - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
                both = np.bincount(owners[at], minlength=m)
                near[k] = both * 100 >= percent * (sizes[k] + sizes - both)
                near[k, k] = False
            if i != j:
                counted = near & (mine[:, None] != mine[None, :])
            else:
                counted = near
            links = counted @ copies
            edges = _forest(m, lambda k, rest: near[k][rest])
            if blocks[0] == 1:
                label = list(range(m))

                def root(x):
                    while label[x] != x:
                        x = label[x]
                    return x

                for x, y in edges:
                    x, y = root(x), root(y)
                    label[x if node[x] > node[y] else y] = y if node[x] > node[y] else x
                rows += [(node[k], None, node[root(k)], int(links[k])) for k in range(m)]
            else:
                rows += [(node[k], None, None, int(links[k])) for k in range(m)]
                rows += [(node[x], node[y], None, 0) for x, y in edges]
            if len(rows) > 10_000:
                yield _table(rows)
                rows = []
        yield _table(rows)

    def _table(rows):
        a, b, label, n = zip(*rows, strict=True) if rows else ((), (), (), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(label, pa.binary()), pa.array(n, pa.int64())], ["node", "other", "label", "links"])

    return groups.mapInArrow(tidy(run), "node binary, other binary, label binary, links long")


def _full_sets(docs: DataFrame, words: int) -> DataFrame:
    """text with passing columns component, blocks, node, copies -> the same with the shingle set as bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in _batches(b.column(0).to_pylist()):
                flat, sizes = shingle_sets(texts, words)
                cuts = np.concatenate(([0], np.cumsum(sizes)))
                sets = [flat[x:y].tobytes() for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(at, len(texts)) for k in (1, 2, 3, 4)), pa.array(sets, pa.binary())], ["component", "blocks", "node", "copies", "set"])

    return docs.select("text", "component", "blocks", "node", "copies").mapInArrow(tidy(run), "component binary, blocks int, node binary, copies long, set binary")


def join_similar(docs: DataFrame, words: int = 5, percent: int = 80, recall: float = 0.99999, limit: int = 2048, depth: int = 3, block: int = 512, block_shingles: int = 300_000) -> DataFrame:
    """docs (doc_id, text) -> doc_id, class_id, n_links: documents (copies included) with a Jaccard of percent / 100 or more."""
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    threshold = percent / 100
    marks = written(_signed(keyed, words), "signed")
    nodes = written(marks.where("node is not null").groupBy("node").agg(F.first("n").alias("n"), F.first("sig").alias("sig"), F.min(F.struct("doc_id", "th")).alias("rep"), F.count("*").alias("copies")), "nodes")
    members = marks.select("doc_id", "node")
    buckets = _buckets(nodes.select("node", "sig"), runs_for(recall, threshold, depth), depth, limit)
    edges = _candidates(buckets, nodes.select("node", "n", "sig"), limit, threshold)
    groups = connected_components(edges)
    grouped = groups.join(nodes.select("node", "rep", "copies", "n"), "node")
    # blocks of bounded memory: not too many sets, nor too large ones
    blocks = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") / block_shingles)).cast("int")
    grouped = written(grouped.join(grouped.groupBy("component").agg(blocks.alias("blocks")), "component"), "groups")
    # a node's set is read from the text of its first document (from each of its rows, where they are repeated)
    first = grouped.select("node", "component", "blocks", "copies", F.col("rep.doc_id").alias("d"), F.col("rep.th").alias("t"))
    texts = keyed.join(first.hint("merge"), keyed["doc_id"].eqNullSafe(first["d"]) & (keyed["th"] == first["t"]))
    sets = _full_sets(texts, words)
    dealt = _blocked(sets, F.col("blocks")).select("component", "i", "j", "blocks", "node", "copies", "mine", "set")
    exact = written(_exact(dealt.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j"), percent), "exact")
    counted = exact.where("other is null").groupBy("node").agg(F.sum("links").alias("links"), F.max("label").alias("label"))
    wide = connected_components(exact.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    facts = nodes.select("node", "rep", "copies").join(counted, "node", "left").join(wide.select("node", F.col("component").alias("wide")), "node", "left")
    facts = written(facts.select("node", "rep", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("wide", "label", "node").alias("class")), "facts")
    discard(nodes, buckets, grouped, exact)
    least = facts.groupBy("class").agg(F.min("rep.doc_id").alias("class_id"))
    facts = facts.join(least, "class").select("node", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    out = members.join(facts, "node", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_similar(documents(spark, sf_dir))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each class of similar ones stays: one with the smallest doc_id (null ids last) and, of these, text hash.

    Rows are told apart by id and text; of rows that repeat both, one stays. Rows without words have no class and stay."""
    keyed = docs.select(F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("th")).alias("doc_id"), "text")
    linked = join_similar(keyed).where("n_links > 0").groupBy("doc_id").agg(F.first("class_id").alias("class_id"), F.count("*").alias("n"))
    least = F.col("doc_id").eqNullSafe(F.col("class_id"))
    marked = written(linked.where(~least | (F.col("n") > 1)).select(F.col("doc_id.id").alias("_id"), F.col("doc_id.th").alias("_of"), least.alias("_least")), "marked")
    hashed = docs.withColumn("_th", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_th") == F.col("_of"))
    # a merge join at every size: marked rows grow with the input, so no broadcast of them is bounded
    rest = hashed.join(marked.hint("merge"), same, "left_anti").select(*docs.columns)
    repeated = marked.where("_least")
    if repeated.isEmpty():
        return rest
    return rest.union(hashed.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "_th"]).select(*docs.columns))


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), p AS (
  SELECT doc_id, ws, unnest(range(greatest(len(ws) - 4, 1))) AS i FROM w WHERE len(ws) > 0
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i + 1:i + 5], ' ') AS g FROM p
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), c AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE common * 100 >= 80 * (x.n + y.n - common)
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
)
SELECT d.doc_id, (SELECT min(b) FROM r WHERE r.a = d.doc_id) AS class_id, (SELECT count(*) FROM l WHERE l.a = d.doc_id) AS n_links FROM documents d
"""
