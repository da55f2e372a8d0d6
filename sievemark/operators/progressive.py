"""Progressive filtering under a rising threshold: in one aggregate where scores stay, else round by round."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import FAMILIES, ProgressiveConfig
from ..functions import text as T
from ..functions.entropy import with_runs
from .shuffles import settled, skew_join


def schedule(config: ProgressiveConfig) -> list[float]:
    """Thresholds of all rounds and the one behind the last, by repeated multiplication."""
    t = [config.initial_threshold]
    for _ in range(config.max_rounds):
        t.append(t[-1] * config.growth_factor)
    return t


def draw(sample_id: Column, round_no: Column | int, seed: int) -> Column:
    """A reproducible uniform number of a sample and a round."""
    no = F.lit(round_no) if isinstance(round_no, int) else round_no
    text = F.concat_ws(":", sample_id.cast("string"), no.cast("string"), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def survives(score: Column, sample_id: Column, threshold: float, round_no: int, config: ProgressiveConfig) -> Column:
    return (score > threshold) | (draw(sample_id, round_no, config.seed) < config.diversity)


@dataclass(frozen=True)
class CurationStats:
    total_rounds: int
    original_size: int
    final_size: int
    reduction_ratio: float  # what is left of the original
    final_threshold: float
    history: list[dict]
    trained_languages: list[str]


def _stop(now: int, original: int, rounds: int, c: ProgressiveConfig) -> bool:
    return now < c.min_samples or (now / original if original else 0) < c.min_fraction or rounds >= c.max_rounds


def filter_rounds(df: DataFrame, config: ProgressiveConfig = ProgressiveConfig(), score: str = "score") -> tuple[DataFrame, CurationStats]:
    """df (sample_id, score, ...) -> what the rounds leave, and their history.

    Scores don't change from round to round, so each row's first failing round tells all: one aggregate over that number
    gives every round's sizes and score ranges."""
    t = schedule(config)
    fails = [F.when(~survives(F.col(score), F.col("sample_id"), t[k], k, config), k) for k in range(config.max_rounds)]
    marked = df.withColumn("_death", F.coalesce(*fails, F.lit(config.max_rounds)))
    by = {r["_death"]: r for r in marked.groupBy("_death").agg(F.count("*").alias("n"), F.sum(score).alias("s"), F.min(score).alias("lo"), F.max(score).alias("hi")).collect()}
    over = lambda k: [r for d, r in by.items() if d >= k]
    size = lambda k: sum(r["n"] for r in over(k))
    original, rounds, history = size(0), 0, []
    while original and not _stop(size(rounds), original, rounds, config):
        left, n = over(rounds + 1), size(rounds + 1)
        history.append({"round": rounds, "threshold": t[rounds], "input_size": size(rounds), "output_size": n, "retention_rate": n / size(rounds) if size(rounds) else 0.0, "mean_score": sum(r["s"] for r in left) / n if n else 0.0, "min_score": min((r["lo"] for r in left), default=0.0), "max_score": max((r["hi"] for r in left), default=0.0), "error_aware": False, "known_features_count": 0})
        rounds += 1
    kept = marked.where(F.col("_death") >= rounds).drop("_death")
    return kept, CurationStats(rounds, original, size(rounds), size(rounds) / original if original else 0.0, t[rounds], history, [])


class Scorer(Protocol):
    """What scores samples in each round: fit is asked for once, where there is one; transform adds `score`."""

    def transform(self, samples: DataFrame) -> DataFrame: ...


def filter_with_callbacks(df: DataFrame, config: ProgressiveConfig, train: Callable[[DataFrame, int], object] | None = None, evaluate: Callable[[object, DataFrame], DataFrame] | None = None, known_languages: list[str] | None = None, scorer: Scorer | None = None) -> tuple[DataFrame, CurationStats]:
    """The loop form: scores are adjusted by errors of the model trained in the round before, and each round is settled.

    train(samples, round) gives a model, evaluate(model, at most 1000 samples) its (sample_id, prediction, reference).
    A scorer scores what is left anew in each round; without one, df's score stays. Texts are needed for error analysis."""
    t, known = schedule(config), list(known_languages or [])
    mastery: dict[str, float] = {}
    features: set[str] = set()  # mastered bigrams: those seen often and seldom wrong in the 1000 evaluated samples
    errors = rates = None
    if scorer is not None:
        scorer = scorer.fit(df) if hasattr(scorer, "fit") else scorer
    original = now = df.count()
    rounds, history = 0, []
    while original and not _stop(now, original, rounds, config):
        scored = df if scorer is None else scorer.transform(df.drop("score"))
        scored = adjusted_scores(scored, errors, rates, known, mastery, config) if config.error_analysis else scored.withColumn("adjusted", F.col("score"))
        kept = settled(scored.where(survives(F.col("adjusted"), F.col("sample_id"), t[rounds], rounds, config)))
        row = kept.agg(F.count("*"), F.avg("adjusted"), F.min("adjusted"), F.max("adjusted")).first()
        history.append({"round": rounds, "threshold": t[rounds], "input_size": now, "output_size": row[0], "retention_rate": row[0] / now if now else 0.0, "mean_score": row[1] or 0.0, "min_score": row[2] or 0.0, "max_score": row[3] or 0.0, "error_aware": errors is not None, "known_features_count": len(mastery) + len(features)})
        df, now = kept.drop("adjusted"), row[0]
        model = train(df, rounds) if train else None
        if train and "language" in df.columns:
            seen = df.where("language is not null").groupBy("language").agg(F.min("sample_ord").alias("o")).orderBy("o").collect()
            known += [r["language"] for r in seen if r["language"] not in known]
        if model is not None and evaluate and config.error_analysis:
            some = df.orderBy("sample_ord").limit(1000)
            language = F.col("language") if "language" in df.columns else F.lit(None).cast("string").alias("language")
            pairs = settled(evaluate(model, some).join(df.select("sample_id", language), "sample_id"))
            errors, rates = settled(error_bigrams(pairs)), settled(language_error_rates(pairs))
            mastery |= known_languages_of(rates)
            if "transcription" in df.columns:
                counts = bigram_counts(some).groupBy("bigram").agg(F.sum("n").alias("cnt"))
                features |= {r["bigram"] for r in known_ngrams(counts, errors).collect()}
        rounds += 1
    return df, CurationStats(rounds, original, now, now / original if original else 0.0, t[rounds], history, known)


def known_languages_of(rates: DataFrame, below: float = 0.1) -> dict[str, float]:
    """Mastery of the languages (one row each) whose error rate is below 10 %."""
    return {r["language"]: 1 - r["wer"] for r in rates.where(F.col("wer") < below).collect()}


def _sides(pairs: DataFrame) -> DataFrame:
    """sample_id, language, the words p and r of both texts, and the words of r that p lacks."""
    sides = pairs.withColumn("p", T.spaced_words(T.text_of("prediction"))).withColumn("r", T.spaced_words(T.text_of("reference")))
    return sides.withColumn("missing", F.array_except("r", "p")).select("sample_id", "language", "p", "r", "missing")


def error_counts(pairs: DataFrame) -> DataFrame:
    """substitutions, insertions, deletions of (prediction, reference) pairs."""
    n = F.size("p") - F.size("r")
    sums = (F.sum(F.size("missing")), F.sum(F.greatest(n, F.lit(0))), F.sum(F.greatest(-n, F.lit(0))))
    return _sides(pairs).agg(*(F.coalesce(s, F.lit(0)).alias(k) for s, k in zip(sums, ("substitutions", "insertions", "deletions"), strict=True)))


def error_bigrams(pairs: DataFrame) -> DataFrame:
    """Reference bigrams one of whose words the prediction lacks -> bigram, cnt.

    The places of missing words come from one sort of a text's words together with its missing ones: where a run of equal
    words begins with a mark of a missing one, all its places are wrong. A text costs n log n."""
    word = lambda w, at: F.struct(w.alias("w"), at.alias("at"))
    both = F.sort_array(F.concat(F.transform("missing", lambda w: word(w, F.lit(-1))), F.transform("r", word)))
    sides = _sides(pairs).withColumn("_all", both).withColumn("_words", F.transform("_all", lambda x: x["w"]))
    sides = with_runs(sides, "_words", "_runs")
    marked = F.filter("_runs", lambda x: F.get("_all", x["at"])["at"] == -1)
    sides = sides.withColumn("_wrong", F.flatten(F.transform(marked, lambda x: F.transform(F.slice("_all", x["at"] + 2, x["n"] - 1), lambda y: y["at"]))))
    starts = F.array_distinct(F.concat("_wrong", F.transform("_wrong", lambda i: i - 1)))
    sides = sides.withColumn("_starts", F.filter(starts, lambda i: (i >= 0) & (i < F.size("r") - 1)))
    grams = F.transform("_starts", lambda i: F.concat_ws(" ", F.get("r", i), F.get("r", i + 1)))
    # an outer explode: from an inner one Spark infers a filter and computes all arrays again in it
    rows = sides.select(grams.alias("_grams")).select(F.explode_outer("_grams").alias("bigram")).where("bigram is not null")
    return rows.groupBy("bigram").agg(F.count("*").alias("cnt"))


def language_error_rates(pairs: DataFrame) -> DataFrame:
    wer = F.size("missing") / F.greatest(F.size("r"), F.lit(1))
    return _sides(pairs).where("language is not null").groupBy("language").agg(F.avg(wer).alias("wer"))


def bigram_counts(df: DataFrame) -> DataFrame:
    """sample_id, bigram, n: a text's bigrams, counted within the row before anything is shuffled."""
    words = df.select("sample_id", T.spaced_words(T.text_of()).alias("_w"))
    out = with_runs(words.withColumn("_sorted", F.sort_array(T.bigrams(F.col("_w")))), "_sorted", "_runs")
    rows = out.select("sample_id", F.explode_outer("_runs").alias("x")).where("x is not null")
    return rows.select("sample_id", F.col("x.item").alias("bigram"), F.col("x.n").cast("long").alias("n"))


def error_relevance(df: DataFrame, errors: DataFrame, rates: DataFrame) -> DataFrame:
    """sample_id, relevance: a tenth for each counted error bigram of the text plus its language's rate, at most 1."""
    grams, errors = settled(bigram_counts(df)), settled(errors)
    # how many texts have it tells which bigrams are too frequent for one task
    weighed = settled(grams.groupBy("bigram").agg(F.count("*").alias("texts")).join(errors, "bigram"))
    hits = skew_join(grams, weighed, ["bigram"], "texts").groupBy("sample_id").agg((F.sum(F.col("cnt") * F.col("n")) * 0.1).alias("hits"))
    joined = df.select("sample_id", "language").join(hits, "sample_id", "left").join(rates, "language", "left")
    return joined.select("sample_id", F.least(F.lit(1.0), F.coalesce("hits", F.lit(0.0)) + F.coalesce("wer", F.lit(0.0))).alias("relevance"))


def cross_lingual_overlap(language: Column, known: list[str]) -> Column:
    """Share of the language's family that is known; 0 outside all families."""
    out = F.when(F.lit(False), 0.0)
    for members in FAMILIES.values():
        out = out.when(language.isin(members), len(set(members) & set(known)) / len(members))
    return out.otherwise(0.0)


def adjusted_scores(df: DataFrame, errors: DataFrame | None, rates: DataFrame | None, known: list[str], mastery: dict[str, float], config: ProgressiveConfig) -> DataFrame:
    """df with `adjusted`: score + errors + half the family overlap - a tenth of the mastery of the row's language."""
    language = F.col("language") if "language" in df.columns else F.lit(None).cast("string")
    score = F.col("score") + config.cross_lingual_weight * 0.5 * cross_lingual_overlap(language, known)
    for k, m in mastery.items():
        score = score - F.when(language == k, 0.1 * m).otherwise(0.0)
    if errors is None:
        return df.withColumn("adjusted", score)
    return df.join(error_relevance(df, errors, rates), "sample_id", "left").withColumn("adjusted", score + config.error_weight * F.coalesce("relevance", F.lit(0.0))).drop("relevance")


def known_ngrams(counts: DataFrame, errors: DataFrame, least: int = 10, most_errors: float = 0.1) -> DataFrame:
    """Bigrams (bigram, cnt) seen often and seldom wrong -> bigram, mastery."""
    both = counts.join(errors.withColumnRenamed("cnt", "err"), "bigram", "left").withColumn("rate", F.coalesce("err", F.lit(0)) / F.col("cnt"))
    return both.where((F.col("cnt") > least) & (F.col("rate") < most_errors)).select("bigram", (F.lit(1.0) - F.col("rate")).alias("mastery"))


def history_summary(stats: CurationStats) -> str:
    lines = ["Progressive filtering history", "=" * 40]
    lines += [f"Round {h['round']}: {h['input_size']} → {h['output_size']} samples ({h['retention_rate']:.1%} retained), τ={h['threshold']:.4f}, mean_score={h['mean_score']:.4f}" for h in stats.history]
    return "\n".join(lines)
