"""One query for each operator over the driver's tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import COMMON_LANGUAGES, DOMAINS, FAMILIES, LETTER_PHONEMES, MARKERS, AcousticConfig, CurationConfig, MutualInfoConfig, ProgressiveConfig, ScorerConfig, SelectorConfig
from ..functions import entropy as E
from ..functions import subtitles as S
from ..functions import text as T
from ..functions.signal import acoustic_entropy, band_edges, frames, spectral_centroid
from ..operators import features as X
from ..operators import progressive as P
from ..operators.cells import CellInformation
from ..operators.scoring import ScorerModel, analyze, component_stats, score_percentiles
from ..operators.selection import retention_rate, select
from ..operators.selection import select_indices as indices
from ..operators.shuffles import settled
from ..sources import ingest as I
from .pipeline import CurationPipeline

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TEXT = ScorerConfig(use_acoustic=False, use_mutual_info=False)


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return I.samples(table(spark, sf, "documents"))


def r6(df: DataFrame) -> DataFrame:
    """Doubles to six decimals: sums of floating numbers depend on their order."""
    return df.select(*((F.round(c, 6) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def padded(base: DataFrame, feature: DataFrame) -> DataFrame:
    """feature for all samples, 0 where there is none."""
    names = [c for c in feature.columns if c != "sample_id"]
    return r6(base.select("sample_id").join(feature, "sample_id", "left").select("sample_id", *(F.coalesce(n, F.lit(0.0)).alias(n) for n in names)))


# --- SQL building blocks -------------------------------------------------------------------------
BARE = r"regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}_\s]', '', 'g')"
WORDS = rf"list_filter(string_split_regex({BARE}, '\s+'), lambda x: x <> '')"
SPACED = r"list_filter(string_split_regex(lower(coalesce({}, '')), '\s+'), lambda x: x <> '')"
D = "d AS (SELECT doc_id::VARCHAR AS sample_id, doc_id AS sample_ord, text, lang AS language, source FROM documents)"
UNI = f"""{D}, w AS (SELECT sample_id, {WORDS} AS ws FROM d), t AS (SELECT sample_id, len(ws) AS n, unnest(ws) AS x FROM w),
c AS (SELECT sample_id, n, x, count(*) AS c FROM t GROUP BY ALL),
uni AS MATERIALIZED (SELECT sample_id, -sum((c / n + 1e-10) / v * log2((c / n + 1e-10) / v)) AS unigram, count(*) / any_value(n) AS diversity
  FROM (SELECT *, sum(c / n + 1e-10) OVER (PARTITION BY sample_id) AS v FROM c) GROUP BY sample_id)"""
BI = """p AS (SELECT sample_id, len(ws) - 1 AS n, unnest(list_zip(ws[1:len(ws) - 1], ws[2:len(ws)])) AS z FROM w WHERE len(ws) > 1),
pc AS (SELECT sample_id, n, z[1] AS a, z[2] AS b, count(*) AS c FROM p GROUP BY ALL),
bi AS MATERIALIZED (SELECT sample_id, -sum(c / n * log2(c / c1 + 1e-10)) AS bigram FROM (SELECT *, sum(c) OVER (PARTITION BY sample_id, a) AS c1 FROM pc) GROUP BY sample_id)"""


def phon_sql(k: int) -> str:
    return f"""s AS (SELECT sample_id, translate(regexp_replace(lower(coalesce(text, '')), '[^a-z ]', '', 'g'), 'cqx', 'kkk') AS s FROM d),
g AS (SELECT sample_id, length(s) - {k} AS n, s, unnest(range(1, length(s) - {k} + 1)) AS i FROM s WHERE length(s) > {k}),
gc AS (SELECT sample_id, n, substr(s, i, {k}) AS x, substr(s, i + {k}, 1) AS f, count(*) AS c FROM g GROUP BY ALL),
gx AS MATERIALIZED (SELECT sample_id, n, x, sum(c) AS nc, count(*) AS k, list(c) AS cs FROM gc GROUP BY ALL),
phon AS MATERIALIZED (SELECT sample_id, sum(-nc / n * (list_sum(list_transform(cs, lambda c: (c + 0.01) / (nc + 0.41) * log2((c + 0.01) / (nc + 0.41)))) + (41 - k) * 0.01 / (nc + 0.41) * log2(0.01 / (nc + 0.41)))) AS phonetic FROM gx GROUP BY sample_id)"""


def _eps_entropy(items: list[str]) -> str:
    """SQL of the entropy of expressions that are shares, a tiny mass added to each."""
    z = " + ".join(f"({x} + 1e-10)" for x in items)
    return "-(" + " + ".join(f"({x} + 1e-10) / ({z}) * log2(({x} + 1e-10) / ({z}))" for x in items) + ")"


_DOM = [" + ".join([*(f"contains(lower(text), '{k}')::INT" for k in ks), "0.1::DOUBLE"]) for ks in DOMAINS.values()]
DOM = "ds AS MATERIALIZED (SELECT sample_id, text, " + ", ".join(f"{x} AS d{i}" for i, x in enumerate(_DOM)) + " FROM (SELECT sample_id, coalesce(text, '') AS text FROM d)), dn AS MATERIALIZED (SELECT sample_id, text, " + ", ".join(f"d{i} / ({' + '.join(f'd{j}' for j in range(13))}) AS d{i}" for i in range(13)) + " FROM ds), dom AS (SELECT sample_id, text, " + _eps_entropy([f"d{i}" for i in range(13)]) + " AS domain FROM dn)"
_MARK = [f"((length(low) - length(replace(low, '{m}', ''))) // {len(m)})" if " " in m else f"len(list_filter(ps, lambda x: x = '{m}'))" for m in MARKERS]
DISC = r"dm AS (SELECT sample_id, lower(coalesce(text, '')) AS low, string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}_]+') AS ps FROM d), dc AS (SELECT sample_id, list_filter([" + ", ".join(_MARK) + "], lambda x: x > 0) AS cs FROM dm), dt AS (SELECT sample_id, cs, list_sum(cs) AS t FROM dc), dp AS (SELECT sample_id, list_transform(cs, lambda c: c / t + 1e-10) AS q FROM dt), disc AS (SELECT sample_id, CASE WHEN len(q) = 0 THEN 0 ELSE -list_sum(list_transform(q, lambda x: x / list_sum(q) * log2(x / list_sum(q)))) END AS discourse FROM dp)"
CTX = rf"ctx AS (SELECT sample_id, CASE WHEN regexp_replace(text, '^\s+|\s+$', '', 'g') = '' THEN 0 ELSE domain + 0.3 * discourse END AS contextual FROM dom JOIN disc USING (sample_id))"
COMP = f"""{UNI}, {BI}, {phon_sql(1)}, {DOM}, {DISC}, {CTX},
comp AS MATERIALIZED (SELECT sample_id, sample_ord, language, coalesce(unigram, 0) + 0.5 * coalesce(bigram, 0) AS linguistic, coalesce(phonetic, 0) AS phonetic, contextual
  FROM d LEFT JOIN uni USING (sample_id) LEFT JOIN bi USING (sample_id) LEFT JOIN phon USING (sample_id) LEFT JOIN ctx USING (sample_id))"""
_mm = lambda c: f"CASE WHEN max({c}) OVER () - min({c}) OVER () < 1e-10 THEN 0.5 ELSE ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) END"
SCORE = f"{COMP}, norm AS MATERIALIZED (SELECT *, {_mm('linguistic')} AS ln, {_mm('phonetic')} AS pn, {_mm('contextual')} AS cn FROM comp), sc AS (SELECT *, 0.20 * pn + 0.25 * ln + 0.15 * cn AS score FROM norm)"
W = "WITH "


def components(spark: SparkSession, sf: str) -> DataFrame:
    return X.text_components(docs(spark, sf)).select("sample_id", "sample_ord", "language", "linguistic", "phonetic", "contextual")


def scored(spark: SparkSession, sf: str) -> DataFrame:
    c = settled(components(spark, sf))  # a few numbers a sample, read by the fit and by the scores
    return ScorerModel.fit(c, TEXT).transform(c)


def rounded(spark: SparkSession, sf: str) -> DataFrame:
    """Scores to nine decimals, for queries that compare or sort by them."""
    return scored(spark, sf).select("sample_id", "sample_ord", "language", F.round("score", 9).alias("score"))


RSC = f"{SCORE}, rs AS MATERIALIZED (SELECT sample_id, sample_ord, language, round(score, 9) AS score FROM sc)"


# --- sources and projections ---------------------------------------------------------------------
@query(W + D + " SELECT sample_id, sample_ord, text AS transcription, language, source FROM d")
def scan_samples(spark, sf):
    return docs(spark, sf)


@query("SELECT doc_id, text FROM documents WHERE lang = 'fr'")
def scan_partition_subset(spark, sf):
    return table(spark, sf, "documents").where("lang = 'fr'").select("doc_id", "text")


@query("SELECT doc_id, lang, source FROM documents WHERE (lang = 'en' AND source = 'src1') OR (lang = 'de' AND source = 'src2')")
def scan_name_split(spark, sf):
    d = table(spark, sf, "documents")
    return I.concatenate([d.where((F.col("lang") == a) & (F.col("source") == b)) for a, b in (("en", "src1"), ("de", "src2"))]).select("doc_id", "lang", "source")


@query("SELECT vec_id, len(embedding) / 16000.0::DOUBLE AS duration FROM embeddings")
def duration(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", I.duration(F.col("embedding"), F.lit(16000)).alias("duration"))


@query("SELECT doc_id, text AS transcript, lang FROM documents")
def rename_text(spark, sf):
    return I.rename_text(table(spark, sf, "documents").select("doc_id", "text", "lang"))


@query("SELECT doc_id, '<|' || lang || '|><|transcribe|>' || text AS transcript FROM documents")
def language_tag(spark, sf):
    return table(spark, sf, "documents").select("doc_id", I.language_tag(F.col("lang"), F.col("text")).alias("transcript"))


@query("SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'de', 'fr')")
def concat_datasets(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang")
    return I.concatenate([d.where(F.col("lang") == x) for x in ("en", "de", "fr")])


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def dataset_count(spark, sf):
    return table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n"))


@query("SELECT doc_id, md5(doc_id::VARCHAR || ':42') AS key, row_number() OVER (ORDER BY md5(doc_id::VARCHAR || ':42')) AS pos FROM documents")
def shuffle(spark, sf):
    return I.shuffled(table(spark, sf, "documents").select("doc_id"), "doc_id")


@query("WITH p AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 32 AS batch FROM documents) SELECT batch, count(*) AS n, min(doc_id) AS first FROM p WHERE batch < (SELECT count(*) FROM documents) // 32 GROUP BY 1")
def batching(spark, sf):
    return I.batches(table(spark, sf, "documents"), "doc_id", 32, drop_last=True).groupBy("batch").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


GROUPS = {"germanic_group": ("en", ["en", "de"]), "romance_group": ("fr", ["fr", "es"])}


@query("SELECT g AS language_group, b AS base_lang, language, count(doc_id) AS n FROM (VALUES ('germanic_group', 'en', 'en'), ('germanic_group', 'en', 'de'), ('romance_group', 'fr', 'fr'), ('romance_group', 'fr', 'es')) v(g, b, language) LEFT JOIN documents ON lang = language GROUP BY ALL")
def language_groups(spark, sf):
    groups = spark.createDataFrame([(g, b, ls) for g, (b, ls) in GROUPS.items()], "language_group string, base_lang string, languages array<string>")
    flat = groups.select("language_group", "base_lang", F.explode("languages").alias("language"))
    d = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("language"))
    return flat.join(d, "language", "left").groupBy("language_group", "base_lang", "language").agg(F.count("doc_id").alias("n"))


# --- tokens and text features ----------------------------------------------------------------------
@query(f"SELECT doc_id, array_to_string({WORDS}, '|') AS tokens FROM documents")
def tokenize_word(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(T.tokenize(T.text_of("text")), "|").alias("tokens"))


@query(f"SELECT doc_id, length({BARE}) AS n, len(list_distinct(string_split(replace({BARE}, ' ', '_'), ''))) AS kinds FROM documents")
def tokenize_char(spark, sf):
    t = table(spark, sf, "documents").select("doc_id", T.tokenize(T.text_of("text"), "character").alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.size(F.array_distinct("t")).cast("long").alias("kinds"))


@query(f"SELECT doc_id, array_to_string(flatten(list_transform({WORDS}, lambda w: CASE WHEN length(w) <= 3 THEN [w] ELSE list_transform(range((length(w) - 1) // 3 + 1), lambda i: substr(w, i * 3 + 1, 3)) END)), '|') AS tokens FROM documents")
def tokenize_subword(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(T.tokenize(T.text_of("text"), "subword"), "|").alias("tokens"))


@query("SELECT doc_id, array_to_string(list_transform(list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^a-z ]', '', 'g'), ''), lambda c: c <> ''), lambda c: (map([" + ", ".join(f"'{k}'" for k in LETTER_PHONEMES) + "], [" + ", ".join(f"'{v}'" for v in LETTER_PHONEMES.values()) + "]))[c]), ' ') AS phonemes FROM documents")
def g2p(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(T.phonemes(T.text_of("text")), " ").alias("phonemes"))


@query("SELECT doc_id, array_to_string(list_filter(list_transform(string_split(regexp_replace(lower(coalesce(text, '')), '[^a-z ]', '', 'g'), ' '), lambda w: upper(w)), lambda p: list_contains(['A', 'I', 'L', 'LA', 'LE', 'DE'], p)), ' ') AS phonemes FROM documents")
def phoneme_inventory(spark, sf):
    """Converter output held to an inventory; the converter here gives upper-case words with a stress digit."""
    words = F.split(F.regexp_replace(F.lower(T.text_of("text")), "[^a-z ]", ""), " ")
    raw = F.transform(words, lambda w: F.concat(F.upper(w), F.lit("1")))
    return table(spark, sf, "documents").select("doc_id", F.array_join(T.in_inventory(raw, ["A", "I", "L", "LA", "LE", "DE"]), " ").alias("phonemes"))


@query("WITH l AS (SELECT doc_id, list_transform(string_split(text, ' '), lambda w: length(w))[1:448] AS ids FROM documents) SELECT doc_id, len(ids) AS n, list_sum(ids)::BIGINT AS total FROM l")
def label_truncation(spark, sf):
    ids = T.truncated(F.transform(F.split("text", " "), lambda w: F.length(w)), 448)
    out = table(spark, sf, "documents").select("doc_id", ids.alias("ids"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n"), F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("WITH p AS (SELECT vec_id, embedding AS a, (row_number() OVER (ORDER BY vec_id) - 1) // 32 AS batch FROM embeddings), c AS (SELECT vec_id, batch, a[1:8 + vec_id % 50] AS a FROM p), m AS (SELECT *, max(len(a)) OVER (PARTITION BY batch) AS most FROM c) SELECT vec_id, most::INT AS n, (most - len(a))::BIGINT AS pads FROM m")
def padded_batches(spark, sf):
    """Signals of unlike length, padded to the longest of their batch."""
    e = table(spark, sf, "embeddings").select("vec_id", F.slice(F.col("embedding"), F.lit(1), (F.col("vec_id") % 50 + 8).cast("int")).alias("a"))
    out = I.padded(I.batches(e, "vec_id", 32), "a", -100.0)
    return out.select("vec_id", F.size("a").alias("n"), F.size(F.filter("a", lambda x: x == -100)).cast("long").alias("pads"))


@query(W + UNI + " SELECT sample_id, round(coalesce(unigram, 0), 6) AS unigram FROM d LEFT JOIN uni USING (sample_id)")
def unigram_entropy(spark, sf):
    d = docs(spark, sf)
    return padded(d, X.unigram_entropy(d).select("sample_id", "unigram"))


@query(W + UNI + " SELECT sample_id, round(coalesce(diversity, 0), 6) AS diversity FROM d LEFT JOIN uni USING (sample_id)")
def type_token_ratio(spark, sf):
    d = docs(spark, sf)
    return padded(d, X.unigram_entropy(d).select("sample_id", "diversity"))


@query(W + UNI + ", " + BI + " SELECT sample_id, round(coalesce(bigram, 0), 6) + 0.0::DOUBLE AS bigram FROM d LEFT JOIN bi USING (sample_id)")
def bigram_entropy(spark, sf):
    d = docs(spark, sf)
    return padded(d, X.bigram_entropy(d))


def _phonetic(k: int):
    def f(spark, sf):
        d = docs(spark, sf)
        return padded(d, X.phonetic_entropy(d, k))

    return f


for _k, _name in ((1, "phonetic_entropy"), (2, "phonetic_entropy_k2")):
    query(W + D + ", " + phon_sql(_k) + " SELECT sample_id, round(coalesce(phonetic, 0), 6) AS phonetic FROM d LEFT JOIN phon USING (sample_id)", _name)(_phonetic(_k))


@query(W + D + r""", s AS (SELECT sample_id, translate(regexp_replace(lower(coalesce(text, '')), '[^a-z ]', '', 'g'), 'cqx', 'kkk') AS s FROM d),
g AS (SELECT sample_id, length(s) AS n, unnest(string_split(s, '')) AS x FROM s WHERE s <> ''), c AS (SELECT sample_id, count(*) / n + 1e-10 AS q FROM g GROUP BY sample_id, n, x),
h AS (SELECT sample_id, -(sum(q / (1 + 41e-10) * log2(q / (1 + 41e-10))) + (41 - count(*)) * 1e-10 / (1 + 41e-10) * log2(1e-10 / (1 + 41e-10))) AS h FROM c GROUP BY sample_id)
SELECT sample_id, round(coalesce(h, 0), 6) AS phoneme_unigram FROM d LEFT JOIN h USING (sample_id)""")
def phoneme_unigram(spark, sf):
    d = docs(spark, sf)
    return padded(d, X.phoneme_unigram(d))


@query(W + D + ", " + DOM + " SELECT sample_id, round(domain, 6) AS domain FROM dom")
def domain_entropy(spark, sf):
    return r6(X.contextual_entropy(docs(spark, sf)).select("sample_id", "domain"))


@query(W + D + ", " + DOM + " SELECT sample_id, " + ", ".join(f"round(d{i}, 6) AS {k}" for i, k in enumerate(DOMAINS)) + " FROM dn")
def classify_domain(spark, sf):
    s = X.contextual_entropy(docs(spark, sf)).select("sample_id", F.col("domain_scores").alias("s"))
    s = s.withColumn("total", F.aggregate("s", F.lit(0.0), lambda a, x: a + x))
    return r6(s.select("sample_id", *((F.col("s")[i] / F.col("total")).alias(k) for i, k in enumerate(DOMAINS))))


@query(W + D + ", " + DISC + " SELECT sample_id, len(cs)::BIGINT AS kinds, coalesce(list_sum(cs), 0)::BIGINT AS total FROM dc")
def discourse_markers(spark, sf):
    c = X.contextual_entropy(docs(spark, sf)).select("sample_id", F.col("markers").alias("c"))
    return c.select("sample_id", F.size("c").cast("long").alias("kinds"), F.aggregate("c", F.lit(0.0), lambda a, x: a + x).cast("long").alias("total"))


@query(W + D + ", " + DISC + " SELECT sample_id, round(discourse, 6) + 0.0::DOUBLE AS discourse FROM disc")
def discourse_entropy(spark, sf):
    return r6(X.contextual_entropy(docs(spark, sf)).select("sample_id", "discourse"))


@query(W + ", ".join((D, DOM, DISC, CTX)) + " SELECT sample_id, round(contextual, 6) AS contextual FROM ctx")
def contextual_entropy(spark, sf):
    return r6(X.contextual_entropy(docs(spark, sf)).select("sample_id", "contextual"))


@query(f"""WITH w AS (SELECT doc_id, list_filter({SPACED.format('text')}, lambda x: length(x) > 2 AND NOT list_contains([{', '.join(f"'{x}'" for x in T.COMMON_WORDS)}], x)) AS ws FROM documents),
u AS (SELECT doc_id, len(list_distinct(ws)) / nullif(len(ws), 0) AS u FROM w)
SELECT doc_id::VARCHAR AS sample_id, round(CASE WHEN u IS NULL THEN 0 WHEN u < 1 THEN -log2(1.0::DOUBLE - u + 1e-10) ELSE 0 END, 6) AS semantic FROM u""")
def semantic_entropy(spark, sf):
    return r6(docs(spark, sf).select("sample_id", X.semantic_entropy(T.text_of()).alias("semantic")))


BENCH_FREQ = f"bt AS (SELECT unnest({WORDS}) AS token FROM benchmark), bf AS (SELECT token, count(*) / (SELECT count(*) FROM bt) AS freq FROM bt GROUP BY token)"


@query(W + UNI + ", " + BENCH_FREQ + ", r AS (SELECT DISTINCT sample_id, x FROM t), b AS (SELECT sample_id, count(*) FILTER (coalesce(freq, 0) < 0.001) * 0.1::DOUBLE AS bonus FROM r LEFT JOIN bf ON x = token GROUP BY sample_id) SELECT sample_id, round(coalesce(bonus, 0), 6) AS bonus FROM d LEFT JOIN b USING (sample_id)")
def rare_word_bonus(spark, sf):
    d = docs(spark, sf)
    return padded(d, X.rare_word_bonus(d, _benchmark_frequencies(spark, sf)))


@query(W + UNI + ", " + BI + " SELECT sample_id, round(coalesce(unigram, 0) + 0.5 * coalesce(bigram, 0), 6) AS linguistic FROM d LEFT JOIN uni USING (sample_id) LEFT JOIN bi USING (sample_id)")
def linguistic_entropy(spark, sf):
    return r6(components(spark, sf).select("sample_id", "linguistic"))


def _benchmark_frequencies(spark, sf):
    tokens = table(spark, sf, "benchmark").select(F.explode_outer(T.tokenize(T.text_of("text"))).alias("token")).where("token is not null")
    n = tokens.count()
    return tokens.groupBy("token").agg((F.count("*") / n).alias("freq"))


@query(W + UNI + ", " + BI + ", " + BENCH_FREQ + ", r AS (SELECT DISTINCT sample_id, x FROM t), b AS (SELECT sample_id, count(*) FILTER (coalesce(freq, 0) < 0.001) * 0.1::DOUBLE AS bonus FROM r LEFT JOIN bf ON x = token GROUP BY sample_id) SELECT sample_id, round(coalesce(unigram, 0) + 0.5 * coalesce(bigram, 0) + coalesce(bonus, 0), 6) AS linguistic FROM d LEFT JOIN uni USING (sample_id) LEFT JOIN bi USING (sample_id) LEFT JOIN b USING (sample_id)")
def linguistic_entropy_rare_words(spark, sf):
    """The bonus for words that are rare in the benchmark is part of the component."""
    return r6(X.linguistic_entropy(docs(spark, sf), common=X.common_tokens(_benchmark_frequencies(spark, sf))).select("sample_id", "linguistic"))


# --- entropies, normalisation, discretisation ------------------------------------------------------
EVENTS = "e AS (SELECT event_type AS y, (user_id % 4)::BIGINT AS x, count(*) AS c FROM events GROUP BY ALL)"


def _events(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("y"), (F.col("user_id") % 4).cast("long").alias("x")).agg(F.count("*").alias("c"))


@query("SELECT event_type AS value, round(count(*) / (SELECT count(*) FROM events), 6) AS p FROM events GROUP BY 1")
def probability_distribution(spark, sf):
    return r6(E.probabilities(table(spark, sf, "events"), "event_type"))


@query("SELECT i AS value, round(coalesce(n, 0) / (SELECT count(*) FROM events), 6) AS p FROM range(8) r(i) LEFT JOIN (SELECT user_id % 6 AS x, count(*) AS n FROM events GROUP BY 1) ON x = i")
def probability_categories(spark, sf):
    """Shares of eight categories, two of which don't occur."""
    return r6(E.probabilities(table(spark, sf, "events").select((F.col("user_id") % 6).cast("long").alias("x")), "x", 8))


@query("WITH c AS (SELECT event_type, count(*) AS c FROM events GROUP BY 1), q AS (SELECT c / (SELECT sum(c) FROM c) + 1e-10 AS q FROM c) SELECT round(-sum(q / z * log2(q / z)), 6) AS h FROM q, (SELECT sum(q) AS z FROM q)")
def shannon_entropy(spark, sf):
    e = table(spark, sf, "events")
    return r6(e.groupBy("event_type").agg(F.count("*").alias("c")).agg(E.entropy_from_counts(F.col("c"), F.lit(e.count())).alias("h")))


@query(W + EVENTS + ", n AS (SELECT sum(c) AS n FROM e), m AS (SELECT x, sum(c) AS m FROM e GROUP BY x) SELECT round(-sum(c / n * log2(least(greatest(c / m, 1e-10), 1))), 6) AS h FROM e JOIN m USING (x), n")
def conditional_entropy(spark, sf):
    e = _events(spark, sf)
    n = e.agg(F.sum("c")).first()[0]
    m = e.groupBy("x").agg(F.sum("c").alias("m"))
    return r6(e.join(m, "x").agg(E.conditional_entropy(F.col("c") / n, F.col("m") / n).alias("h")))


@query(W + EVENTS + """, m AS (SELECT x, sum(c) AS m FROM e GROUP BY x), n AS (SELECT sum(c) AS n FROM e), p AS (SELECT c / n + 1e-10 AS j, m / n + 1e-10 AS m FROM e JOIN m USING (x), n),
z AS (SELECT (SELECT sum(j) FROM p) AS zj, (SELECT sum(m / n + 1e-10) FROM m, n) AS zm) SELECT round(-sum(j / zj * log2(least(greatest(j / zj / (m / zm), 1e-10), 1))), 6) AS h FROM p, z""")
def conditional_entropy_smoothed(spark, sf):
    """With a tiny mass on joint and marginal shares, both brought back to a sum of 1."""
    e = _events(spark, sf)
    n = e.agg(F.sum("c")).first()[0]
    m = e.groupBy("x").agg(F.sum("c").alias("m"))
    return r6(E.smoothed_conditional_entropy(e.join(m, "x").select("x", (F.col("c") / n).alias("j"), (F.col("m") / n).alias("m")), "j", "m", "x"))


def _prices(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("double").alias("v"))


PRICE = "p AS (SELECT l_orderkey, l_linenumber, l_extendedprice::DOUBLE AS v FROM lineitem)"


@query(W + PRICE + " SELECT l_orderkey, l_linenumber, round((v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()), 6) AS v FROM p")
def normalize_minmax(spark, sf):
    return r6(E.normalize_scores(_prices(spark, sf), "v", "minmax"))


@query(W + PRICE + " SELECT l_orderkey, l_linenumber, round((v - avg(v) OVER ()) / stddev_pop(v) OVER (), 5) AS v FROM p")
def normalize_zscore(spark, sf):
    return E.normalize_scores(_prices(spark, sf), "v", "zscore").withColumn("v", F.round("v", 5))


@query("WITH v AS (SELECT event_type, exp(avg(value) / 100) AS x FROM events GROUP BY 1) SELECT event_type, round(x / sum(x) OVER (), 6) AS v FROM v")
def normalize_softmax(spark, sf):
    return r6(E.normalize_scores(table(spark, sf, "events").groupBy("event_type").agg((F.avg("value") / 100).alias("v")), "v", "softmax"))


@query(W + COMP + " SELECT sample_id, round((least(greatest((linguistic - avg(linguistic) OVER ()) / stddev_pop(linguistic) OVER (), -3), 3) + 3) / 6, 6) AS z FROM comp")
def normalize_component(spark, sf):
    c = settled(components(spark, sf))
    return r6(c.select("sample_id", E.scaled(F.col("linguistic"), component_stats(c, ["linguistic"])["linguistic"], "zscore").alias("z")))


@query(W + PRICE + " SELECT b AS bin, count(*) AS n FROM (SELECT least(greatest(floor((v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()) * 64), 0), 63)::INT AS b FROM p) GROUP BY 1")
def discretize_uniform(spark, sf):
    return E.discretize(_prices(spark, sf), "v", 64, "uniform").groupBy("bin").agg(F.count("*").alias("n"))


@query("WITH p AS (SELECT l_quantity::DOUBLE AS v FROM lineitem), e AS (SELECT list_sort(list_distinct(quantile_cont(v, [i / 16 for i in range(17)]))) AS e FROM p) SELECT len(list_filter(e[2:len(e) - 1], lambda x: x <= v))::INT AS bin, count(*) AS n FROM p, e GROUP BY 1")
def discretize_quantile(spark, sf):
    p = table(spark, sf, "lineitem").select(F.col("l_quantity").cast("double").alias("v"))
    return E.discretize(p, "v", 16, "quantile").groupBy("bin").agg(F.count("*").alias("n"))


# --- scores and selection -------------------------------------------------------------------------
@query(W + COMP + "".join(f"{' UNION ALL' if i else ''} SELECT '{c}' AS component, round(min({c}), 6) AS min, round(max({c}), 6) AS max, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std FROM comp" for i, c in enumerate(("linguistic", "phonetic", "contextual"))))
def component_statistics(spark, sf):
    stats = component_stats(components(spark, sf), ["linguistic", "phonetic", "contextual"])
    return r6(spark.createDataFrame([(k, v["min"], v["max"], v["mean"], v["std"]) for k, v in stats.items()], "component string, min double, max double, mean double, std double"))


@query(W + SCORE + "".join(f"{' UNION ALL' if i else ''} SELECT '{c}' AS component, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std, round(min({c}), 6) AS min, round(max({c}), 6) AS max, round(quantile_cont({c}, 0.5), 6) AS median FROM sc" for i, c in enumerate(("linguistic", "phonetic", "contextual", "score"))))
def analyze_dataset(spark, sf):
    return r6(analyze(scored(spark, sf), ["linguistic", "phonetic", "contextual", "score"]))


@query(W + SCORE + ", q AS (SELECT quantile_cont(score, [0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]) AS v FROM sc) SELECT unnest([10, 25, 50, 75, 90, 95, 99]) AS percentile, round(unnest(v), 6) AS value FROM q", "score_percentiles")
def _score_percentiles(spark, sf):
    return r6(score_percentiles(scored(spark, sf)))


@query(W + SCORE + " SELECT sample_id, round(score, 6) AS score FROM sc")
def score(spark, sf):
    return r6(scored(spark, sf).select("sample_id", "score"))


@query(W + SCORE + " SELECT sample_id, round(0.25 * ln, 6) AS score FROM sc")
def score_subset(spark, sf):
    c = settled(components(spark, sf))
    only = ScorerConfig(use_acoustic=False, use_phonetic=False, use_contextual=False, use_mutual_info=False)
    return r6(ScorerModel.fit(c, only).transform(c).select("sample_id", "score"))


@query(W + SCORE + " SELECT sample_id, " + ", ".join(f"round({c}, 6) AS {c}_raw, round({n}, 6) AS {c}_normalized, round({n} * {w}, 6) AS {c}_weighted" for c, n, w in (("phonetic", "pn", 0.2), ("linguistic", "ln", 0.25), ("contextual", "cn", 0.15))) + ", round(score, 6) AS total_score FROM sc")
def score_detailed(spark, sf):
    c = settled(components(spark, sf))
    return r6(ScorerModel.fit(c, TEXT).detailed(c))


@query(W + RSC + " SELECT sample_id, score FROM rs WHERE score > 0.3")
def select_threshold(spark, sf):
    return select(rounded(spark, sf), SelectorConfig("threshold", threshold=0.3)).select("sample_id", "score")


@query(W + RSC + " SELECT sample_id, score FROM rs WHERE score >= (SELECT quantile_cont(score, 0.7) FROM rs)")
def select_percentile(spark, sf):
    return select(rounded(spark, sf), SelectorConfig("percentile", percentile=30)).select("sample_id", "score")


@query(W + RSC + " SELECT sample_id, score FROM rs ORDER BY score DESC, sample_ord LIMIT 100")
def select_top_k(spark, sf):
    return select(rounded(spark, sf), SelectorConfig("top_k", top_k=100)).select("sample_id", "score")


@query(W + RSC + ", k AS (SELECT sample_ord, score FROM rs ORDER BY score DESC, sample_ord LIMIT 50) SELECT sample_ord, row_number() OVER (ORDER BY score, sample_ord) AS place FROM k")
def select_indices(spark, sf):
    return indices(rounded(spark, sf), SelectorConfig("top_k", top_k=50))


@query(W + RSC + " SELECT sample_ord, row_number() OVER (ORDER BY sample_ord) AS place FROM rs WHERE score > 0.4")
def select_indices_threshold(spark, sf):
    return indices(rounded(spark, sf), SelectorConfig("threshold", threshold=0.4))


@query(W + RSC + " SELECT sample_ord, row_number() OVER (ORDER BY sample_ord) AS place FROM rs WHERE score >= (SELECT quantile_cont(score, 0.8) FROM rs)")
def select_indices_percentile(spark, sf):
    return indices(rounded(spark, sf), SelectorConfig("percentile", percentile=20))


@query(W + RSC + " SELECT round(avg((score > 0.3)::INT), 6) AS rate FROM rs", "retention_rate")
def _retention(spark, sf):
    return r6(rounded(spark, sf).agg(retention_rate(F.col("score") > 0.3).alias("rate")))


@query(W + RSC + " SELECT sample_id FROM rs WHERE score > 0.3 ORDER BY sample_ord LIMIT 1000")
def eval_subset(spark, sf):
    return rounded(spark, sf).where("score > 0.3").orderBy("sample_ord").limit(1000).select("sample_id")


# --- cells ------------------------------------------------------------------------------------------
_NAMES = ("words", "unique", "mean_length", "chars")


def _features(spark, sf):
    return settled(docs(spark, sf).select("sample_id", *(v.alias(k) for k, v in X.mi_text_features(T.text_of()).items())))


MI = D + f""", w AS (SELECT sample_id, length(coalesce(text, '')) AS n, {SPACED.format('text')} AS ws FROM d),
f AS MATERIALIZED (SELECT sample_id, least(len(ws) / 100.0::DOUBLE, 1) AS words, CASE WHEN len(ws) > 0 THEN len(list_distinct(ws)) / len(ws) ELSE 0 END AS "unique",
  CASE WHEN len(ws) > 0 THEN list_sum(list_transform(ws, lambda x: length(x))) / len(ws) / 10.0::DOUBLE ELSE 0 END AS mean_length, least(n / 500.0::DOUBLE, 1) AS chars FROM w)"""
_EDGES = "[i / 32 for i in range(33)]"


def _mi_sql(distinct_lookup: bool) -> str:
    raw = ", ".join(f'quantile_cont("{n}", {_EDGES}) AS r_{n}' for n in _NAMES)
    uniq = ", ".join(f"list_sort(list_distinct(r_{n})) AS u_{n}" for n in _NAMES)
    cell = lambda p: "((" + " * 32 + ".join(f'least(len(list_filter({p}_{n}[2:len({p}_{n}) - 1], lambda x: x <= "{n}")), 31){")" if i in (1, 2) else ""}' for i, n in enumerate(_NAMES))
    return f"{MI}, r AS (SELECT {raw} FROM f), e AS MATERIALIZED (SELECT *, {uniq} FROM r), k AS MATERIALIZED (SELECT sample_id, {cell('u')} AS fit, {cell('u' if distinct_lookup else 'r')} AS look FROM f, e), n AS (SELECT fit AS cell, count(*) AS cnt FROM k GROUP BY 1)"


@query(W + MI + ' SELECT sample_id, round(words, 6) AS words, round("unique", 6) AS "unique", round(mean_length, 6) AS mean_length, round(chars, 6) AS chars FROM f')
def mi_features_linguistic(spark, sf):
    return r6(_features(spark, sf))


@query(W + MI + "".join(f"{' UNION ALL' if i else ','} {'q AS (' if not i else ''}SELECT '{n}' AS feature, generate_subscripts(e, 1) - 1 AS i, round(unnest(e), 6) AS edge FROM (SELECT quantile_cont(\"{n}\", {_EDGES}) AS e FROM f)" for i, n in enumerate(_NAMES)) + ") SELECT feature, i::INT AS i, edge FROM q")
def quantile_edges(spark, sf):
    edges = CellInformation.fit(_features(spark, sf), _NAMES).edges
    return r6(spark.createDataFrame([(n, i, float(v)) for n in _NAMES for i, v in enumerate(edges[n])], "feature string, i int, edge double"))


@query(W + _mi_sql(True) + " SELECT cell, cnt FROM n")
def mi_cell_counts(spark, sf):
    f = _features(spark, sf)
    return CellInformation.fit(f, _NAMES).counts(f)


def _mutual(mode: str):
    def run(spark, sf):
        f = _features(spark, sf)
        return r6(CellInformation.fit(f, _NAMES, edge_mode=mode).transform(f).select("sample_id", "mutual_info"))

    return run


for _mode, _name in (("consistent", "mutual_information"), ("reference", "mutual_information_raw_edges")):
    query(W + _mi_sql(_mode == "consistent") + " SELECT sample_id, round(-log2((coalesce(cnt, 0) + 1e-10) / ((SELECT count(*) FROM f) + 1e-10 * 32 ** 4) + 1e-10), 6) AS mutual_info FROM k LEFT JOIN n ON look = cell", _name)(_mutual(_mode))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS a FROM embeddings)
SELECT vec_id, round(least(len(a) / 16000 / 30, 1), 6) AS duration, round(least(sqrt(list_sum(list_transform(a, lambda x: x * x)) / len(a)) / 0.1, 1), 6) AS rms,
round(list_sum(list_transform(range(1, len(a)), lambda i: abs(sign(a[i + 1]) - sign(a[i])) / 2)) / (len(a) - 1), 6) AS zcr FROM e""")
def mi_features_acoustic(spark, sf):
    f = X.mi_signal_features(F.col("embedding"), F.lit(16000))
    return r6(table(spark, sf, "embeddings").select("vec_id", *(v.alias(k) for k, v in f.items())))


#: A short transform for the short signals of the table; half of them are cut to 32 samples.
SIGNAL = AcousticConfig(n_bands=5, n_fft=16, hop=8, n_bins=4)


def _signals(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", F.when(F.col("vec_id") % 2 == 0, F.col("embedding")).otherwise(F.slice("embedding", 1, 32)).alias("audio"))


SIGNALS = "sg AS (SELECT vec_id, list_transform(CASE WHEN vec_id % 2 = 0 THEN embedding ELSE embedding[1:32] END, lambda x: x::DOUBLE) AS a FROM embeddings)"
_FRAMES = f"{SIGNALS}, fr AS (SELECT vec_id, unnest(range(0, 1 + len(a) // 8)) AS frame, a || list_transform(range(16), lambda i: 0.0::DOUBLE) AS a FROM sg)"


@query(W + _FRAMES + " SELECT vec_id, frame::INT AS frame, round(list_sum(list_transform(range(16), lambda i: a[frame * 8 + i + 1] * (i + 1))), 3) + 0.0::DOUBLE AS weighted FROM fr")
def frames_of_signal(spark, sf):
    """Every frame of every signal; the weighted sum tells the order of its samples."""
    f = _signals(spark, sf).select("vec_id", F.posexplode(frames(F.col("audio"), SIGNAL.n_fft, SIGNAL.hop)).alias("frame", "f"))
    weighted = F.aggregate(F.transform("f", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return f.select("vec_id", "frame", (F.round(weighted, 3) + 0.0).alias("weighted"))


def _acoustic_sql() -> str:
    """The bands of a Hann-windowed Fourier transform, their quantile bins and entropies, written out."""
    edges = band_edges(SIGNAL)
    bands = " UNION ALL ".join(f"SELECT vec_id, frame, {i} AS band, {'ln(1 + avg(m))' if b > a else '0.0::DOUBLE'} AS v FROM mg" + (f" WHERE k >= {a} AND k < {b}" if b > a else "") + " GROUP BY 1, 2" for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)))
    turn = "2 * pi() * i * k / 16"
    term = lambda f: f"list_sum(list_transform(range(16), lambda i: a[frame * 8 + i + 1] * (0.5 - 0.5 * cos(2 * pi() * i / 15)) * {f}({turn})))"
    return f"""{_FRAMES}, fk AS (SELECT vec_id, frame, a, unnest(range(9)) AS k FROM fr), mg AS MATERIALIZED (SELECT vec_id, frame, k, sqrt({term('cos')} ** 2 + {term('sin')} ** 2) AS m FROM fk),
bd AS ({bands}), bv AS (SELECT vec_id, band, list(v) AS vs, list_sort(list_distinct(quantile_cont(v, [i / 4 for i in range(5)]))) AS e FROM bd GROUP BY 1, 2),
bb AS (SELECT vec_id, band, len(vs) AS n, unnest(list_transform(vs, lambda v: CASE WHEN len(e) > 2 THEN least(len(list_filter(e[2:len(e) - 1], lambda x: x <= v)), 3) ELSE 0 END)) AS bin FROM bv),
bc AS (SELECT vec_id, band, bin, (count(*) / any_value(n) + 1e-10) / (1 + 4e-10) AS q FROM bb GROUP BY 1, 2, 3),
bh AS (SELECT vec_id, band, -sum(q * log2(q)) - (4 - count(*)) * (1e-10 / (1 + 4e-10)) * log2(1e-10 / (1 + 4e-10)) AS h FROM bc GROUP BY 1, 2),
ac AS MATERIALIZED (SELECT vec_id, avg(h) AS acoustic FROM bh GROUP BY 1)"""


def _centroid_sql() -> str:
    term = lambda f: f"list_sum(list_transform(range(len(a)), lambda i: a[i + 1] * {f}(2 * pi() * i * k / len(a))))"
    return f"ck AS (SELECT vec_id, a, unnest(range(0, len(a) // 2 + 1)) AS k FROM sg), cm AS (SELECT vec_id, k, len(a) // 2 + 1 AS n, sqrt({term('cos')} ** 2 + {term('sin')} ** 2) AS m FROM ck), ce AS MATERIALIZED (SELECT vec_id, CASE WHEN sum(m) > 1e-10 THEN sum(k * m) / sum(m) / any_value(n) ELSE 0.5 END AS centroid FROM cm GROUP BY 1)"


@query(W + _acoustic_sql() + ", " + _centroid_sql() + " SELECT vec_id, round(acoustic, 6) AS acoustic, round(centroid, 6) AS centroid FROM ac JOIN ce USING (vec_id)")
def acoustic_features(spark, sf):
    return r6(_signals(spark, sf).select("vec_id", acoustic_entropy(F.col("audio"), SIGNAL).alias("acoustic"), spectral_centroid(F.col("audio")).alias("centroid")))


# --- all five components ------------------------------------------------------------------------------
ALL = CurationConfig(acoustic=SIGNAL, mutual_info=MutualInfoConfig("linguistic"))


def _voiced(spark, sf):
    """Documents that have a signal, with it."""
    return docs(spark, sf).join(_signals(spark, sf).withColumnRenamed("vec_id", "sample_ord"), "sample_ord").withColumn("sample_rate", F.lit(16000))


_VOICED = D.replace("FROM documents", "FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)")
_FIVE = [("acoustic", 0.25), ("phonetic", 0.20), ("linguistic", 0.25), ("contextual", 0.15), ("mutual_info", 0.15)]


def _five_sql() -> str:
    mi = _mi_sql(True)[len(D) + 2 :].replace("w AS (", "mw AS (").replace("FROM w)", "FROM mw)").replace(", r AS (", ", mr AS (").replace("FROM r)", "FROM mr)").replace(", e AS MATERIALIZED", ", me AS MATERIALIZED").replace("FROM f, e)", "FROM f, me)").replace(", n AS (", ", mn AS (")
    return f"""{COMP.replace(D, _VOICED)}, {mi}, {_acoustic_sql()},
five AS MATERIALIZED (SELECT comp.*, acoustic, -log2((cnt + 1e-10) / ((SELECT count(*) FROM f) + 1e-10 * 32 ** 4) + 1e-10) AS mutual_info FROM comp JOIN ac ON vec_id = sample_ord JOIN k USING (sample_id) JOIN mn ON fit = cell),
fs AS MATERIALIZED (SELECT sample_id, {', '.join(f'{c}, {_mm(c)} AS n_{c}' for c, _ in _FIVE)} FROM five)"""


@query(W + _five_sql() + " SELECT sample_id, " + ", ".join(f"round({c}, 6) AS {c}_raw, round(n_{c}, 6) AS {c}_normalized, round(n_{c} * {w}, 6) AS {c}_weighted" for c, w in _FIVE) + ", round(" + " + ".join(f"{w} * n_{c}" for c, w in _FIVE) + ", 6) AS total_score FROM fs")
def score_all_components(spark, sf):
    """The facade with all five components, in detail."""
    d = settled(_voiced(spark, sf))
    return r6(CurationPipeline(ALL).score_detailed(d))


# --- progressive filtering --------------------------------------------------------------------------
CONFIG = ProgressiveConfig(initial_threshold=0.2, min_samples=20, max_rounds=10)
_T = P.schedule(CONFIG)
_draw = lambda k: f"('0x' || substr(md5(sample_id || ':{k}:42'), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
DEATH = RSC + ", de AS MATERIALIZED (SELECT *, CASE " + " ".join(f"WHEN NOT (score > {t!r} OR {_draw(k)} < 0.05) THEN {k}" for k, t in enumerate(_T[:-1])) + " ELSE 10 END AS death FROM rs), k AS (SELECT coalesce(min(r), 10) AS k FROM (SELECT r, (SELECT count(*) FROM de WHERE death >= r) AS n, (SELECT count(*) FROM de) AS t FROM range(11) x(r)) WHERE n < 20 OR n / t < 0.1 OR r >= 10)"


@query("SELECT unnest(range(11))::INT AS round, round(unnest([" + ", ".join(f"{t!r}::DOUBLE" for t in P.schedule(ProgressiveConfig())) + "]), 9) AS threshold")
def threshold_schedule(spark, sf):
    return spark.createDataFrame([(i, round(t, 9)) for i, t in enumerate(P.schedule(ProgressiveConfig()))], "round int, threshold double")


@query(W + RSC + " SELECT sample_id FROM rs WHERE score > 0.35")
def filter_round(spark, sf):
    return rounded(spark, sf).where(F.col("score") > 0.35).select("sample_id")


@query(W + RSC + f" SELECT sample_id FROM rs WHERE score > 0.35 OR {_draw(0)} < 0.05")
def filter_round_diversity(spark, sf):
    return rounded(spark, sf).where(P.survives(F.col("score"), F.col("sample_id"), 0.35, 0, ProgressiveConfig())).select("sample_id")


@query(W + DEATH + " SELECT sample_id, score FROM de, k WHERE death >= k")
def progressive_filter(spark, sf):
    return P.filter_rounds(rounded(spark, sf), CONFIG)[0].select("sample_id", "score")


@query(W + DEATH + ", th AS (SELECT unnest(range(10)) AS round, unnest([" + ", ".join(f"{t!r}::DOUBLE" for t in _T[:-1]) + "]) AS threshold) SELECT round::INT AS round, round(threshold, 6) AS threshold, (SELECT count(*) FROM de WHERE death >= round) AS input_size, (SELECT count(*) FROM de WHERE death > round) AS output_size, round((SELECT avg(score) FROM de WHERE death > round), 6) AS mean_score FROM th, k WHERE round < k")
def round_history(spark, sf):
    h = P.filter_rounds(rounded(spark, sf), CONFIG)[1].history
    return spark.createDataFrame([(x["round"], round(x["threshold"], 6), x["input_size"], x["output_size"], round(x["mean_score"], 6)) for x in h], "round int, threshold double, input_size long, output_size long, mean_score double")


@query(W + DEATH + ", th AS (SELECT unnest(range(10)) AS round, unnest([" + ", ".join(f"{t!r}::DOUBLE" for t in _T[:-1]) + """]) AS threshold),
rh AS (SELECT round, threshold, (SELECT count(*) FROM de WHERE death >= round) AS i, (SELECT count(*) FROM de WHERE death > round) AS o, coalesce((SELECT avg(score) FROM de WHERE death > round), 0) AS m FROM th, k WHERE round < k)
SELECT 'Progressive filtering history' || chr(10) || repeat('=', 40) || coalesce(string_agg(chr(10) || printf('Round %d: %d → %d samples (%.1f%% retained), τ=%.4f, mean_score=%.4f', round, i, o, o / i * 100, threshold, m), '' ORDER BY round), '') AS summary FROM rh""")
def history_summary(spark, sf):
    return spark.createDataFrame([(P.history_summary(P.filter_rounds(rounded(spark, sf), CONFIG)[1]),)], "summary string")


@query(W + RSC + " SELECT language, min(sample_ord) AS first FROM rs WHERE score > 0.3 AND language IS NOT NULL GROUP BY 1")
def trained_languages(spark, sf):
    return rounded(spark, sf).where("score > 0.3 and language is not null").groupBy("language").agg(F.min("sample_ord").alias("first"))


def _pairs(spark, sf, every=5):
    """Documents against themselves without every fifth (or so) word."""
    d = docs(spark, sf)
    words = T.nonempty(F.split(T.text_of(), r"\s+"))
    worse = F.array_join(F.filter(words, lambda w, i: i % every != every - 1), " ")
    return d.select("sample_id", "language", worse.alias("prediction"), F.col("transcription").alias("reference"))


PAIRS = D + r""", r0 AS (SELECT sample_id, language, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '') AS ws FROM d),
pr AS (SELECT sample_id, language, list_transform(ws, lambda x: lower(x)) AS r, list_transform(list_filter(ws, lambda x, i: (i - 1) % 5 <> 4), lambda x: lower(x)) AS p FROM r0),
ms AS MATERIALIZED (SELECT *, list_filter(list_distinct(r), lambda x: NOT list_contains(p, x)) AS miss FROM pr)"""
ERR = ", eb AS (SELECT b AS bigram, count(*) AS cnt FROM (SELECT miss, unnest(list_transform(range(1, len(r)), lambda i: r[i] || ' ' || r[i + 1])) AS b FROM ms WHERE len(r) > 1) WHERE list_contains(miss, string_split(b, ' ')[1]) OR list_contains(miss, string_split(b, ' ')[2]) GROUP BY 1)"
LER = ", lr AS (SELECT language, avg(len(miss) / greatest(len(r), 1)) AS wer FROM ms WHERE language IS NOT NULL GROUP BY 1)"
GRAMS = ", gr AS (SELECT sample_id, unnest(list_transform(range(1, len(r)), lambda i: r[i] || ' ' || r[i + 1])) AS bigram FROM pr WHERE len(r) > 1)"
REL = ", hit AS (SELECT sample_id, sum(cnt) * 0.1::DOUBLE AS h FROM gr JOIN eb USING (bigram) GROUP BY 1), rel AS (SELECT d.sample_id, least(1.0::DOUBLE, coalesce(h, 0) + coalesce(wer, 0)) AS relevance FROM d LEFT JOIN hit USING (sample_id) LEFT JOIN lr ON lr.language = d.language)"


@query(W + PAIRS + " SELECT sum(len(miss))::BIGINT AS substitutions, sum(greatest(len(p) - len(r), 0))::BIGINT AS insertions, sum(greatest(len(r) - len(p), 0))::BIGINT AS deletions FROM ms")
def analyze_errors(spark, sf):
    return P.error_counts(_pairs(spark, sf))


@query(W + PAIRS + ERR + " SELECT bigram, cnt FROM eb")
def error_bigrams(spark, sf):
    return P.error_bigrams(_pairs(spark, sf))


@query(W + PAIRS + LER + " SELECT language, round(wer, 6) AS wer FROM lr")
def language_error_rate(spark, sf):
    return r6(P.language_error_rates(_pairs(spark, sf)))


MASTERED = PAIRS.replace("% 5 <> 4", "% 12 <> 11")


@query(W + MASTERED + LER + " SELECT language, round(1 - wer, 6) AS mastery FROM lr WHERE wer < 0.1")
def known_languages(spark, sf):
    known = P.known_languages_of(P.language_error_rates(_pairs(spark, sf, 12)))
    return r6(spark.createDataFrame(list(known.items()), "language string, mastery double"))


@query(W + PAIRS + ERR + GRAMS + ", n AS (SELECT bigram, count(*) AS c FROM gr GROUP BY 1) SELECT bigram, round(1 - coalesce(cnt, 0) / c, 6) AS mastery FROM n LEFT JOIN eb USING (bigram) WHERE c > 10 AND coalesce(cnt, 0) / c < 0.1")
def known_ngrams(spark, sf):
    counts = P.bigram_counts(docs(spark, sf)).groupBy("bigram").agg(F.sum("n").alias("cnt"))
    return r6(P.known_ngrams(counts, P.error_bigrams(_pairs(spark, sf))))


@query(W + PAIRS + ERR + LER + GRAMS + REL + " SELECT sample_id, round(relevance, 6) AS relevance FROM rel")
def error_relevance(spark, sf):
    p = _pairs(spark, sf)
    return r6(P.error_relevance(docs(spark, sf), P.error_bigrams(p), P.language_error_rates(p)))


_family = "CASE " + " ".join(f"WHEN language IN ({', '.join(repr(m) for m in ms)}) THEN {len(set(ms) & set(COMMON_LANGUAGES)) / len(ms)!r}::DOUBLE" for ms in FAMILIES.values()) + " ELSE 0 END"


@query(W + D + f" SELECT sample_id, round({_family}, 6) AS overlap FROM d")
def cross_lingual(spark, sf):
    return r6(docs(spark, sf).select("sample_id", P.cross_lingual_overlap(F.col("language"), COMMON_LANGUAGES).alias("overlap")))


_MS = MASTERED[len(D) :].replace("r0 AS", "r1 AS").replace("FROM r0", "FROM r1").replace("pr AS", "pr1 AS").replace("FROM pr)", "FROM pr1)").replace("ms AS", "ms1 AS") + LER.replace("lr AS", "lr1 AS").replace("FROM ms", "FROM ms1")


@query(W + RSC + PAIRS[len(D) :] + ERR + LER + GRAMS + REL + _MS + f" SELECT rs.sample_id, round(score + 0.3 * relevance + 0.2 * 0.5 * {_family.replace('language', 'rs.language')} - CASE WHEN lr1.wer < 0.1 THEN 0.1 * (1 - lr1.wer) ELSE 0 END, 6) AS adjusted FROM rs JOIN rel USING (sample_id) LEFT JOIN lr1 ON lr1.language = rs.language")
def adjust_scores(spark, sf):
    """Errors of one model, mastery of languages by a better one."""
    p = _pairs(spark, sf)
    d = docs(spark, sf).select("sample_id", "transcription").join(rounded(spark, sf), "sample_id")
    mastery = P.known_languages_of(P.language_error_rates(_pairs(spark, sf, 12)))
    return r6(P.adjusted_scores(d, P.error_bigrams(p), P.language_error_rates(p), COMMON_LANGUAGES, mastery, ProgressiveConfig()).select("sample_id", "adjusted"))


# --- transcripts -------------------------------------------------------------------------------------
def _results(spark, sf):
    c = table(spark, sf, "conversations").withColumn("start", F.col("turn") * 2.5)
    chunk = F.struct("turn", F.col("start").alias("start"), (F.col("start") + 2.25).alias("end"), "text")
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(chunk)).alias("chunks"))
    text = F.array_join(F.transform("chunks", lambda x: x["text"]), " ")
    return g.select(F.col("conv_id").cast("string").alias("file"), text.alias("text"), "chunks", (F.size("chunks") * 0.5).alias("inference_time"), (F.size("chunks") * 2.5).alias("audio_duration"))


_strip = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
_hms = lambda s: f"lpad(floor({s} / 3600)::INT::VARCHAR, 2, '0') || ':' || lpad((floor({s} / 60)::INT % 60)::VARCHAR, 2, '0') || ':' || lpad((floor({s})::INT % 60)::VARCHAR, 2, '0') || '{{}}' || lpad((floor({s} * 1000)::INT % 1000)::VARCHAR, 3, '0')"
_conv = "c AS (SELECT conv_id, turn, text, turn * 2.5::DOUBLE AS s, turn * 2.5::DOUBLE + 2.25 AS e, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS i FROM conversations)"


@query(W + _conv + " SELECT conv_id::VARCHAR AS file, string_agg(text, ' ' ORDER BY i) AS out FROM c GROUP BY conv_id")
def format_txt(spark, sf):
    r = _results(spark, sf)
    return r.select("file", S.formatted(r, "txt").alias("out"))


@query(W + _conv + f" SELECT conv_id::VARCHAR AS file, string_agg(i || chr(10) || {_hms('s').format(',')} || ' --> ' || {_hms('e').format(',')} || chr(10) || {_strip} || chr(10), chr(10) ORDER BY i) AS out FROM c GROUP BY conv_id")
def format_srt(spark, sf):
    r = _results(spark, sf)
    return r.select("file", S.formatted(r, "srt").alias("out"))


@query(W + _conv + f" SELECT conv_id::VARCHAR AS file, 'WEBVTT' || chr(10) || chr(10) || string_agg({_hms('s').format('.')} || ' --> ' || {_hms('e').format('.')} || chr(10) || {_strip} || chr(10), chr(10) ORDER BY i) AS out FROM c GROUP BY conv_id")
def format_vtt(spark, sf):
    r = _results(spark, sf)
    return r.select("file", S.formatted(r, "vtt").alias("out"))


_JSON_CHUNK = """'{' || chr(10) || '    "turn" : ' || turn || ',' || chr(10) || '    "start" : ' || s || ',' || chr(10) || '    "end" : ' || e || ',' || chr(10) || '    "text" : ' || to_json(text)::VARCHAR || chr(10) || '  }'"""


@query(W + _conv + f""" SELECT conv_id::VARCHAR AS file, '{{' || chr(10) || '  "file" : "' || conv_id || '",' || chr(10) || '  "text" : ' || to_json(string_agg(text, ' ' ORDER BY i))::VARCHAR || ',' || chr(10)
|| '  "chunks" : [ ' || string_agg({_JSON_CHUNK}, ', ' ORDER BY i) || ' ],' || chr(10) || '  "inference_time" : ' || (count(*) * 0.5::DOUBLE) || ',' || chr(10) || '  "audio_duration" : ' || (count(*) * 2.5::DOUBLE) || chr(10) || '}}' AS out FROM c GROUP BY conv_id""")
def format_json(spark, sf):
    r = _results(spark, sf)
    return r.select("file", S.formatted(r, "json").alias("out"))


@query("SELECT conv_id::VARCHAR AS file, round(count(*) * 0.5::DOUBLE / (count(*) * 2.5::DOUBLE), 6) AS rtf FROM conversations GROUP BY conv_id")
def rtf(spark, sf):
    return r6(_results(spark, sf).select("file", S.rtf(F.col("inference_time"), F.col("audio_duration")).alias("rtf")))


@query("SELECT count(DISTINCT conv_id) AS files, count(*) * 2.5::DOUBLE AS audio, count(*) * 0.5::DOUBLE AS inference, round(0.5::DOUBLE / 2.5, 6) AS rtf FROM conversations")
def rtf_summary(spark, sf):
    return r6(S.rtf_summary(_results(spark, sf)))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens, entropies, normalisation, threshold."""
    return select(scored(spark, sf), SelectorConfig("threshold", threshold=0.3)).select("sample_id", "score")
