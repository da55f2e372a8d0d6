"""Text and signal features, selection and progressive filtering on small fixtures with known values."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import io
import wave

from sievemark.config import CurationConfig, MutualInfoConfig, ProgressiveConfig, ScorerConfig, SelectorConfig
from sievemark.functions import entropy, subtitles
from sievemark.functions import text as T
from sievemark.functions.signal import acoustic_entropy, acoustic_entropy_of, centroid_of, spectral_centroid
from sievemark.operators import features as X
from sievemark.operators import progressive as P
from sievemark.operators.quantiles import exact_quantiles
from sievemark.operators.selection import select, select_indices
from sievemark.operators.shuffles import skew_join
from sievemark.plans.pipeline import CurationPipeline, mi_features
from sievemark.plans.queries import QUERIES
from sievemark.sources import ingest

TEXTS = {
    "Hello world this is a test": (2.584963, 2.281099, 2.869051),
    "The quick brown fox jumps over the lazy dog": (3.072703, 2.454435, 2.869051),
    "Um well you know like basically": (2.584963, 2.419619, 3.141619),
    "Patient presents with acute symptoms requiring immediate attention": (3.0, 2.504276, 2.249283),
    "Well, you know, I think we should proceed": (3.0, 2.517179, 3.169051),
    "aaa aaa aaa": (0.0, 1.338733, 3.700440),
    "": (0.0, 0.0, 0.0),
}


def test_text_goldens(spark):
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(TEXTS)], "sample_id string, transcription string")
    got = {r["transcription"]: (r["linguistic"], r["phonetic"], r["contextual"]) for r in X.text_components(df).collect()}
    for t, want in TEXTS.items():
        assert got[t] == pytest.approx(want, abs=1e-5), t


def test_null_text_is_empty(spark):
    df = spark.createDataFrame([("a", None)], "sample_id string, transcription string")
    assert X.text_components(df).select("linguistic", "phonetic", "contextual").first() == (0.0, 0.0, 0.0)


def test_signal_goldens():
    t = np.arange(16000) / 16000
    assert acoustic_entropy_of(np.zeros(16000)) == pytest.approx(0, abs=1e-6)
    assert acoustic_entropy_of(np.sin(2 * np.pi * (200 * t + 300 * t * t))) == pytest.approx(5.469728, abs=1e-3)
    assert centroid_of(np.sin(2 * np.pi * 440 * t)) == pytest.approx(0.054993, abs=1e-4)
    assert centroid_of([]) == 0.5


@pytest.mark.parametrize(("config", "want"), [(SelectorConfig("threshold", threshold=0.45), 5), (SelectorConfig("percentile", percentile=50), 5), (SelectorConfig("top_k", top_k=3), 3), (SelectorConfig("top_k", top_k=0), 0)])
def test_selection(spark, config, want):
    df = spark.range(10).select(F.col("id").alias("sample_ord"), (F.col("id") / 10).alias("score"))
    assert select(df, config).count() == want


def test_rounds_equal_a_plain_loop(spark):
    rng = np.random.default_rng(1)
    rows = [(str(i), i, float(s)) for i, s in enumerate(rng.random(600))]
    df = spark.createDataFrame(rows, "sample_id string, sample_ord long, score double")
    c = ProgressiveConfig(min_samples=50)
    kept, stats = P.filter_rounds(df, c)
    loop, other = P.filter_with_callbacks(df, c)
    assert {r["sample_id"] for r in kept.collect()} == {r["sample_id"] for r in loop.collect()}
    assert [h["output_size"] for h in stats.history] == [h["output_size"] for h in other.history]
    assert math.isclose(P.schedule(c)[10], 0.778123, abs_tol=1e-6)
    assert "Round 0" in P.history_summary(stats)


def test_errors(spark):
    pairs = spark.createDataFrame([("1", "the cat sat on mat", "the cat sat on the mat", "en"), ("2", "hello word", "hello world", "en"), ("3", "a b c d", "a b c", "en")], "sample_id string, prediction string, reference string, language string")
    assert tuple(P.error_counts(pairs).first()) == (1, 1, 1)
    assert [tuple(r) for r in P.error_bigrams(pairs).collect()] == [("hello world", 1)]


def test_unreadable_subsets_are_left_out(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "a"))
    assert len(ingest.read_subsets(spark, [str(tmp_path / "a"), str(tmp_path / "missing")])) == 1
    with pytest.raises(ValueError):
        ingest.concatenate([])


def test_shuffle_returns_every_row(spark, tmp_path):
    ids = [3 * k for k in range(1000)]
    spark.createDataFrame([(i, "t") for i in ids], "doc_id long, text string").repartition(7).write.parquet(str(tmp_path / "documents.parquet"))
    keys = sorted((hashlib.md5(f"{i}:42".encode()).hexdigest(), i) for i in ids)
    want = [(i, key, pos) for pos, (key, i) in enumerate(keys, 1)]
    assert [tuple(r) for r in QUERIES["shuffle"](spark, str(tmp_path)).orderBy("pos").collect()] == want
    assert ingest.shuffled(spark.createDataFrame([], "doc_id long"), "doc_id").count() == 0


def test_batches_follow_positions(spark):
    ids = [7 * k + 1000 for k in range(100)]
    df = spark.createDataFrame([(i,) for i in ids], "doc_id long").repartition(5)
    got = ingest.batches(df, "doc_id", 32, drop_last=True).collect()
    assert sorted((r["doc_id"], r["batch"]) for r in got) == [(i, k // 32) for k, i in enumerate(ids[:96])]
    assert ingest.batches(df, "doc_id", 32).count() == 100


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_quantiles(spark, few):
    rng = np.random.default_rng(3)
    columns = {"normal": rng.normal(size=5000), "ties": rng.integers(0, 3, 5000).astype(float), "wide": np.exp(rng.normal(size=5000) * 50), "one": np.full(5000, 7.0)}
    rows = [tuple(float(v[i]) for v in columns.values()) + (None if i % 2 else float(i),) for i in range(5000)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in [*columns, "halves"]))
    at = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    got = exact_quantiles(df, [*columns, "halves"], at, few=few, buckets=16)
    for c, v in (columns | {"halves": np.arange(0, 5000, 2.0)}).items():
        assert got[c] == pytest.approx(np.quantile(v, at).tolist(), rel=1e-12), c
    assert exact_quantiles(df.limit(0), ["normal"], at, few=few) == {"normal": []}


def test_skew_join_equals_a_join(spark):
    rng = np.random.default_rng(4)
    keys = [int(k) for k in np.where(rng.random(3000) < 0.4, 7, rng.integers(0, 400, 3000))] + [None, 900]
    left = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k int, i int")
    right = left.where("k is not null and k <> 900").groupBy("k").agg(F.count("*").alias("n"), F.max("i").alias("top"))
    for how in ("inner", "left"):
        want = left.join(right, ["k"], how)
        assert sorted(map(tuple, skew_join(left, right, ["k"], "n", how).select(*want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_unknown_methods_raise(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (None,)], "v double")
    with pytest.raises(ValueError):
        entropy.normalize_scores(df, "v", "rank")
    with pytest.raises(ValueError):
        entropy.discretize(df, "v", method="kmeans")
    with pytest.raises(ValueError):
        mi_features(df.withColumn("transcription", F.lit("a")), "visual")
    assert [r["v"] for r in entropy.normalize_scores(df, "v").collect()] == [0.0, 1.0, None]
    assert {r["v"] for r in entropy.normalize_scores(df.where("v = 1"), "v").collect()} == {0.5}
    assert {r["v"] for r in entropy.normalize_scores(df.where("v = 1"), "v", "zscore").collect()} == {0.0}
    assert sum(r["v"] for r in entropy.normalize_scores(df.where("v > 0"), "v", "softmax").collect()) == pytest.approx(1)
    assert entropy.normalize_scores(df.limit(0), "v").count() == 0
    assert [r["bin"] for r in entropy.discretize(df, "v", 4, "quantile").collect()] == [0, 3, None]


def _samples(spark):
    texts = list(TEXTS)
    rng = np.random.default_rng(9)
    return spark.createDataFrame([(str(i), i, texts[i % len(texts)], [float(x) for x in rng.normal(size=400)], 16000, ["en", "de", "hi", None][i % 4]) for i in range(40)], "sample_id string, sample_ord long, transcription string, audio array<double>, sample_rate int, language string")


def test_facade(spark, tmp_path):
    df = _samples(spark)
    pipeline = CurationPipeline(CurationConfig(progressive=ProgressiveConfig(min_samples=2)))
    scored = {r["sample_id"]: r["score"] for r in pipeline.score(df).collect()}
    assert len(scored) == 40 and all(0 <= s <= 1 + 1e-9 for s in scored.values())
    pipeline.save(spark, str(tmp_path / "model"))
    again = CurationPipeline.load(spark, str(tmp_path / "model"))
    assert again.get_config() == pipeline.get_config()
    assert {r["sample_id"]: r["score"] for r in again.score(df).collect()} == pytest.approx(scored)
    kept, stats = pipeline.run(df)
    assert kept.count() == stats.final_size and stats.original_size == 40 and stats.history[0]["known_features_count"] == 0
    assert pipeline.select_single_round(df, top_k=5).count() == 5
    long, points = pipeline.analyze_dataset(df)
    assert long.count() == 6 and points.count() == 7
    for kind in ("linguistic", "acoustic", "combined"):
        one = CurationPipeline(CurationConfig(scorer=ScorerConfig(use_acoustic=False, use_phonetic=False, use_linguistic=False, use_contextual=False), mutual_info=MutualInfoConfig(kind)))
        assert one.score(df).count() == 40
    rare = CurationPipeline(frequencies=spark.createDataFrame([("hello", 0.5), ("world", 0.5)], "token string, freq double"))
    plain = {r["transcription"]: r["linguistic"] for r in CurationPipeline().components(df).collect()}
    assert all(r["linguistic"] == pytest.approx(plain[r["transcription"]] + 0.1 * len(set(T_words(r["transcription"])) - {"hello", "world"})) for r in rare.components(df).collect())


def T_words(t):
    import re

    return re.sub(r"[^\w\s]", "", t.lower()).split()


def test_facade_on_an_empty_table(spark):
    kept, stats = CurationPipeline().run(_samples(spark).limit(0))
    assert kept.count() == 0 and (stats.total_rounds, stats.original_size, stats.final_size, stats.history) == (0, 0, 0, [])


def test_callbacks_and_scorer(spark):
    df = _samples(spark).withColumn("score", F.col("sample_ord") / 40)
    seen = []

    class Halved:
        def fit(self, samples):
            seen.append(("fit", samples.count()))
            return self

        def transform(self, samples):
            return samples.withColumn("score", F.col("sample_ord") / 80)

    def train(samples, no):
        seen.append((no, samples.count()))
        return f"model {no}"

    def evaluate(model, samples):
        return samples.select("sample_id", F.regexp_replace("transcription", "^[A-Z][a-z]+", "x").alias("prediction"), F.col("transcription").alias("reference"))

    kept, stats = P.filter_with_callbacks(df, ProgressiveConfig(min_samples=5, max_rounds=3), train, evaluate, ["en"], Halved())
    assert seen[0] == ("fit", 40) and [n for n, _ in seen[1:]] == [0, 1, 2][: len(seen) - 1]
    assert [h["error_aware"] for h in stats.history] == [False, True, True][: len(stats.history)]
    assert set(stats.trained_languages) >= {"en"} and stats.final_size == kept.count()
    # languages of few errors are mastered and lose a tenth of that
    adjusted = P.adjusted_scores(df, None, None, [], {"en": 0.9}, ProgressiveConfig()).collect()
    assert all(r["adjusted"] == pytest.approx(r["score"] - (0.09 if r["language"] == "en" else 0)) for r in adjusted)


def test_error_bigrams_of_repeated_words(spark):
    pairs = spark.createDataFrame([("1", "b", "a b a a c b", "en"), ("2", "", "x", "en"), ("3", None, None, None)], "sample_id string, prediction string, reference string, language string")
    got = {r["bigram"]: r["cnt"] for r in P.error_bigrams(pairs).collect()}
    assert got == {"a b": 1, "b a": 1, "a a": 1, "a c": 1, "c b": 1}


def test_signals_of_unlike_lengths(spark):
    rng = np.random.default_rng(10)
    signals = [[float(x) for x in rng.normal(size=n)] for n in (0, 5, 700, 700, 3000)] + [None, [0.0] * 700]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(signals)], "i int, audio array<double>").coalesce(1)
    got = df.select("i", acoustic_entropy(F.col("audio")).alias("h"), spectral_centroid(F.col("audio")).alias("c")).orderBy("i").collect()
    assert [r["h"] for r in got] == pytest.approx([acoustic_entropy_of(s) for s in signals]) and [r["c"] for r in got] == pytest.approx([centroid_of(s) for s in signals])


def test_indices(spark):
    df = spark.range(10).select(F.col("id").alias("sample_ord"), ((F.col("id") * 7) % 10 / 10).alias("score"))
    by = lambda c: [r["sample_ord"] for r in select_indices(df, c).orderBy("place").collect()]
    assert by(SelectorConfig("threshold", threshold=0.65)) == [1, 4, 7]
    assert by(SelectorConfig("percentile", percentile=30)) == [1, 4, 7]
    assert by(SelectorConfig("top_k", top_k=3)) == [1, 4, 7]


def _wav(path, x, width, channels=1, rate=8000):
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        if width == 1:
            raw = (x * 127 + 128).astype(np.uint8).tobytes()
        else:
            raw = b"".join(int(v * ((1 << (8 * width - 1)) - 1)).to_bytes(width, "little", signed=True) for v in x)
        w.writeframes(raw)


def test_audio_files(spark, tmp_path):
    x = np.sin(np.arange(800) / 20) * 0.5
    for width in (1, 2, 3, 4):
        _wav(tmp_path / f"{width}.wav", x, width)
    _wav(tmp_path / "5.WAV", np.repeat(x, 2), 2, channels=2)
    (tmp_path / "6.wav").write_bytes(b"no audio")
    (tmp_path / "notes.txt").write_text("no audio")
    files = ingest.audio_files(spark, str(tmp_path))
    got = ingest.decode_wav(files, rate=8000).orderBy("file").collect()
    assert [r["file"].rsplit("/", 1)[1] for r in got] == ["1.wav", "2.wav", "3.wav", "4.wav", "5.WAV", "6.wav"]
    assert got[5]["audio"] is None and all(np.allclose(r["audio"], x, atol=0.02) for r in got[:5])
    assert len(ingest.decode_wav(files.where("file like '%2.wav'"), rate=16000).first()["audio"]) == 1600

    def make():
        return lambda f: f[["file"]].assign(text="said")

    assert {r["text"] for r in ingest.transcribe(files, make, "file string, text string").collect()} == {"said"}


def test_text_sinks(spark, tmp_path):
    rows = [(f"f{i}", f"text {i}", None, 1.0) for i in range(9)]
    df = spark.createDataFrame(rows, "file string, text string, chunks array<struct<start:double,end:double,text:string>>, inference_time double").repartition(3)
    for _ in range(2):
        subtitles.append_text(df, "txt", str(tmp_path / "out"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()) == sorted(f"text {i}" for i in range(9) for _ in range(2))
    out = io.StringIO()
    subtitles.show_text(df, "unheard of", out)
    assert out.getvalue().split("\n")[:2] == ["text 0", "text 1"]


def test_languages_inventory_labels_padding(spark, tmp_path):
    (tmp_path / "languages.csv").write_text("code,language\naa,Afar\nde,German\n")
    assert [tuple(r) for r in ingest.read_languages(spark, str(tmp_path / "languages.csv")).collect()] == [("aa", "Afar"), ("de", "German")]
    df = spark.createDataFrame([(["HH", "AH0", " ", "?"], 0), (["L"], 0), (None, 1)], "p array<string>, batch int")
    assert df.select(T.in_inventory(F.col("p"), ["HH", "AH", "SIL"]).alias("x")).first()["x"] == ["HH", "AH", "SIL"]
    assert df.select(F.size(T.truncated(F.col("p"), 2)).alias("n")).first()["n"] == 2
    assert df.select(T.phonemes(F.lit("ab"), g2p=lambda t: F.array(F.upper(t))).alias("x")).first()["x"] == ["AB"]
    assert sorted(r["p"] for r in ingest.padded(df, "p", "-").collect()) == [[], ["HH", "AH0", " ", "?"], ["L", "-", "-", "-"]]
