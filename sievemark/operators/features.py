"""Per-sample text features. All counts are made within the row: its items are sorted and their runs measured, so a text
costs n log n, nothing is shuffled and no task holds more than its own rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EPSILON, N_PHONEMES, LinguisticConfig
from ..functions import text as T
from ..functions.entropy import entropy_of_runs, sum_by_context, with_runs

ID = "sample_id"


def with_unigrams(df: DataFrame, words: str) -> DataFrame:
    """df with unigram (entropy of the words, 0 for none) and diversity (kinds of words / words)."""
    out = with_runs(df.withColumn("_sorted", F.sort_array(words)), "_sorted", "_runs").withColumn("_n", F.size(words))
    diversity = F.when(F.col("_n") > 0, F.size("_runs") / F.col("_n")).otherwise(0.0)
    return out.withColumns({"unigram": entropy_of_runs("_runs", "_n"), "diversity": diversity}).drop("_sorted", "_runs", "_n")


def with_bigrams(df: DataFrame, words: str) -> DataFrame:
    """df with bigram: entropy of a word given the one before it, 0 for texts of fewer than two words."""
    out = with_runs(df.withColumn("_sorted", F.sort_array(T.bigrams(F.col(words)))), "_sorted", "_runs").withColumn("_n", F.size("_sorted"))
    # sum c log2(c / c1 + eps) with the mass taken to first order: what is left out is under 1e-19
    total = sum_by_context(F.col("_runs"), lambda x: F.substring_index(x, " ", 1), lambda c: c * F.log2(c), lambda n, k, s: s - n * F.log2(n) + k * n * (EPSILON / math.log(2)))
    return out.withColumn("bigram", F.when(F.col("_n") == 0, 0.0).otherwise(-total / F.col("_n"))).drop("_sorted", "_runs", "_n")


def with_phonetic(df: DataFrame, text: Column, context: int = 1, smoothing: float = 0.01) -> DataFrame:
    """df with phonetic: conditional entropy of a phoneme behind `context` others, smoothed over the whole inventory in
    closed form; 0 for texts without such a phoneme."""
    out = df.withColumn("_s", T.nonempty(F.split(T.letters(text), "")))
    many = F.size("_s") - context
    grams = F.slice("_s", F.lit(1), F.greatest(many, F.lit(0)))
    for k in range(context):
        grams = F.zip_with(grams, F.slice("_s", F.lit(k + 2), F.greatest(many, F.lit(0))), lambda a, b: F.concat(a, b))
    out = out.withColumn("_sorted", F.sort_array(F.when(many > 0, grams).otherwise(F.array().cast("array<string>"))))
    out = with_runs(out, "_sorted", "_runs").withColumn("_n", F.size("_sorted"))

    def entropy(n: Column, k: Column, s: Column) -> Column:
        d = n + smoothing * N_PHONEMES
        q0 = F.lit(smoothing) / d
        return -n / F.col("_n") * ((s - F.log2(d) * (n + smoothing * k)) / d + (F.lit(N_PHONEMES) - k) * q0 * F.log2(q0))

    total = sum_by_context(F.col("_runs"), lambda x: F.substring(x, 1, context), lambda c: (c + smoothing) * F.log2(c + smoothing), entropy)
    return out.withColumn("phonetic", total).drop("_s", "_sorted", "_runs", "_n")


def _tokens(df: DataFrame, mode: str) -> DataFrame:
    return df.withColumn("_words", T.tokenize(T.text_of(), mode))


def unigram_entropy(df: DataFrame, mode: str = "word") -> DataFrame:
    return with_unigrams(_tokens(df, mode), "_words").select(ID, "unigram", "diversity")


def bigram_entropy(df: DataFrame, mode: str = "word") -> DataFrame:
    return with_bigrams(_tokens(df, mode), "_words").select(ID, "bigram")


def phonetic_entropy(df: DataFrame, context: int = 1, smoothing: float = 0.01) -> DataFrame:
    return with_phonetic(df, T.text_of(), context, smoothing).select(ID, "phonetic")


def phoneme_unigram(df: DataFrame) -> DataFrame:
    out = with_runs(df.withColumn("_sorted", F.sort_array(T.nonempty(F.split(T.letters(T.text_of()), "")))), "_sorted", "_runs").withColumn("_n", F.size("_sorted"))
    return out.select(ID, entropy_of_runs("_runs", "_n", N_PHONEMES).alias("phoneme_unigram"))


def _entropy_of_counts(counts: str, total: str) -> Column:
    """Entropy of an array column of counts as shares of their total, a tiny mass added to each; 0 for none."""
    z = F.lit(1.0) + F.size(counts) * EPSILON
    share = lambda x: x / F.col(total) + EPSILON
    return F.when(F.size(counts) == 0, 0.0).otherwise(-F.aggregate(counts, F.lit(0.0), lambda a, x: a + share(x) * F.log2(share(x))) / z + F.log2(z))


def semantic_entropy(text: Column) -> Column:
    words = T.content_words(text)
    u = F.size(F.array_distinct(words)) / F.size(words)
    return F.when(F.size(words) == 0, 0.0).when(u < 1, -F.log2(F.lit(1.0) - u + EPSILON)).otherwise(0.0)


def contextual_entropy(df: DataFrame, marker_weight: float = 0.3, semantic: bool = False) -> DataFrame:
    """df with domain_scores, markers (counts that occur), domain, discourse and contextual.

    Each step is a projection of its own, so that the text is lowered and split once."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double"))
    out = df.withColumn("_low", F.lower(T.text_of()))
    out = with_runs(out.withColumn("_pieces", F.sort_array(T.marker_pieces(F.col("_low")))), "_pieces", "_counted")
    out = out.withColumns({"domain_scores": T.domain_scores(F.col("_low")).cast("array<double>"), "markers": T.marker_counts(F.col("_low"), F.col("_counted"))})
    out = out.withColumns({"_d": total("domain_scores"), "_m": total("markers")})
    out = out.withColumns({"domain": _entropy_of_counts("domain_scores", "_d"), "discourse": _entropy_of_counts("markers", "_m")})
    h = F.col("domain") + marker_weight * F.col("discourse")
    if semantic:
        h = h + semantic_entropy(T.text_of())
    blank = F.regexp_replace("_low", r"^\s+|\s+$", "") == ""
    return out.withColumn("contextual", F.when(blank, 0.0).otherwise(h)).drop("_low", "_pieces", "_counted", "_d", "_m")


def common_tokens(frequencies: DataFrame, config: LinguisticConfig = LinguisticConfig()) -> list[str]:
    """The tokens of a reference corpus (token, freq; shares that sum to 1) that are not rare: 1 / threshold at most."""
    return sorted(r["token"] for r in frequencies.where(F.col("freq") >= config.rare_threshold).select("token").distinct().collect())


def _bonus(words: str, common: list[str], config: LinguisticConfig) -> Column:
    kinds = F.array_distinct(words)
    known = F.array(*map(F.lit, common)).cast("array<string>")
    return F.size(F.array_except(kinds, known)) * config.rare_bonus


def rare_word_bonus(df: DataFrame, frequencies: DataFrame, config: LinguisticConfig = LinguisticConfig()) -> DataFrame:
    """A bonus for each distinct token that is rare in a reference corpus (token, freq); unknown tokens are rare."""
    return _tokens(df, config.mode).select(ID, _bonus("_words", common_tokens(frequencies, config), config).alias("bonus"))


def linguistic_entropy(df: DataFrame, config: LinguisticConfig = LinguisticConfig(), common: list[str] | None = None) -> DataFrame:
    """df with linguistic: unigram entropy, weighted bigram entropy and, where a corpus's common tokens are given, the
    bonus for rare words."""
    out = with_bigrams(with_unigrams(_tokens(df, config.mode), "_words"), "_words")
    value = F.col("unigram") + (config.bigram_weight * F.col("bigram") if config.use_bigrams else F.lit(0.0))
    if common is not None:
        value = value + _bonus("_words", common, config)
    return out.withColumn("linguistic", value).drop("_words", "unigram", "diversity", "bigram")


def text_components(df: DataFrame, config: LinguisticConfig = LinguisticConfig(), common: list[str] | None = None) -> DataFrame:
    """df (sample_id, transcription) -> all its columns with linguistic, phonetic and contextual entropies, row by row.
    The common tokens of a reference corpus switch the bonus for rare words on. Empty texts are 0 in each."""
    parts = with_phonetic(linguistic_entropy(contextual_entropy(df), config, common), T.text_of())
    return parts.select(*df.columns, "linguistic", "phonetic", "contextual")


def mi_text_features(text: Column) -> dict[str, Column]:
    words = T.spaced_words(text)
    n = F.size(words)
    mean = F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w)) / n
    return {"words": F.least(n / 100.0, F.lit(1.0)), "unique": F.when(n > 0, F.size(F.array_distinct(words)) / n).otherwise(0.0), "mean_length": F.when(n > 0, mean / 10.0).otherwise(0.0), "chars": F.least(F.length(text) / 500.0, F.lit(1.0))}


def mi_signal_features(audio: Column, rate: Column) -> dict[str, Column]:
    """Duration, loudness and zero crossings of a waveform; 0 for an empty one."""
    n = F.size(audio)
    power = F.aggregate(audio, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    steps = F.zip_with(F.slice(audio, F.lit(1), n - 1), F.slice(audio, F.lit(2), n - 1), lambda a, b: F.abs(F.signum(b.cast("double")) - F.signum(a.cast("double"))) / 2)
    crossings = F.aggregate(steps, F.lit(0.0), lambda a, x: a + x)
    return {"duration": F.least(n / rate / 30.0, F.lit(1.0)), "rms": F.when(n > 0, F.least(F.sqrt(power / n) / 0.1, F.lit(1.0))).otherwise(0.0), "zcr": F.when(n > 1, crossings / (n - 1)).otherwise(0.0)}
