"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import op7_decontaminate
from .fingerprint import op4_fingerprint
from .jaccard_join import OP5_SQL, op5_jaccard_join
from .language_id import op1_language_id
from .mixture import op10_mixture
from .personal_data import op2_personal_data
from .substring_dedup import OP6_SQL, op6_substring_dedup
from .token_count import op3_token_count
from .token_file import op9_token_file
from .toxicity import op8_toxicity

QUERIES = {f.__name__: f for f in (op1_language_id, op2_personal_data, op3_token_count, op4_fingerprint, op5_jaccard_join, op6_substring_dedup, op7_decontaminate, op8_toxicity, op9_token_file, op10_mixture)}
ORACLES: dict[str, str] = {"op5_jaccard_join": OP5_SQL, "op6_substring_dedup": OP6_SQL}

# --- parts of results that SQL can say, of operators whose whole result it can't -----------------------
WORDS = r"len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))"


def personal_data_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base spans of every document by kind, from operator 2."""
    return op2_personal_data(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that operator 4 compares with the documents' own."""
    return op4_fingerprint(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What operator 10 takes from each source in all, beside its target."""
    each = op10_mixture(spark, sf_dir).withColumn("source_size", F.col("source_size").cast("long"))
    sums = each.groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.count("*").alias("documents"))
    return sums.select("source_size", F.round("target", 3).alias("target"), (F.abs(F.col("taken") - F.col("target")) <= 1).alias("met"), "documents")


QUERIES |= {f.__name__: f for f in (personal_data_counts, edited_texts, mix_targets)}
ORACLES["personal_data_counts"] = r"""
WITH m AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS email, regexp_extract_all(coalesce(text, ''), '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS ip,
    list_transform(regexp_extract_all(coalesce(text, ''), '[0-9]([ -]?[0-9])+'), lambda x: regexp_replace(x, '[ -]', '', 'g')) AS card, regexp_extract_all(coalesce(text, ''), '\+[0-9][ ().0-9-]+[0-9]') AS phone FROM documents
)
SELECT doc_id, len(email)::BIGINT AS n_email, len(list_filter(ip, lambda x: len(list_filter(string_split(x, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(try_cast(right(p, 3) AS INT), 0) > 255)) = 0))::BIGINT AS n_ip,
  len(list_filter(card, lambda x: length(x) BETWEEN 12 AND 19 AND list_sum(list_transform(range(length(x)), lambda i: CASE WHEN i % 2 = 0 THEN x[length(x) - i]::INT ELSE x[length(x) - i]::INT * 2 - CASE WHEN x[length(x) - i]::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0))::BIGINT AS n_card,
  len(list_filter(phone, lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 9 AND 15))::BIGINT AS n_phone FROM m
"""
ORACLES["edited_texts"] = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS nxt FROM d)
SELECT doc_id, length(t)::BIGINT AS n_chars, sha256(left(t, length(t) - length(t) // 4) || left(nxt, length(t) // 4)) AS edited_sha256 FROM n
"""
# Sources in the order of size / weight: those at the front are capped, the others share what these leave.
ORACLES["mix_targets"] = f"""
WITH d AS (SELECT source, {WORDS} AS n FROM documents), s AS (SELECT source, sum(n) AS size, count(*) AS documents FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s),
r AS (SELECT *, row_number() OVER (ORDER BY size / w, source) AS r FROM w WHERE size > 0),
f AS (SELECT *, ((SELECT sum(size) FROM r) - coalesce(sum(3 * size) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM r),
k AS (SELECT min(r) AS k FROM f WHERE w * share <= 3 * size)
SELECT source_size, round(target, 3) AS target, true AS met, sum(documents)::BIGINT AS documents FROM (
  SELECT size::BIGINT AS source_size, CASE WHEN r < k THEN 3.0 * size ELSE w * (SELECT share FROM f, k WHERE r = k) END AS target, documents FROM f, k
  UNION ALL SELECT 0, 0, documents FROM w WHERE size = 0) GROUP BY source_size, target
"""
