"""Reading and assembling data sets: samples, named subsets, audio files, tags, concatenation, seeded order."""

from __future__ import annotations

import io
import logging
import wave
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

log = logging.getLogger(__name__)
# Audio file extensions.
AUDIO_EXTENSIONS = ("wav", "mp3", "flac", "m4a", "ogg", "webm")


def samples(documents: DataFrame) -> DataFrame:
    """documents -> sample_id, sample_ord, transcription, language, source."""
    return documents.select(F.col("doc_id").cast("string").alias("sample_id"), F.col("doc_id").alias("sample_ord"), F.col("text").alias("transcription"), F.col("lang").alias("language"), "source")


def read_subsets(spark: SparkSession, paths: list[str]) -> list[DataFrame]:
    """The tables that can be read; others are told in the log and left out (schemas are resolved here)."""
    found = []
    for p in paths:
        try:
            df = spark.read.parquet(p)
            df.schema  # noqa: B018
            found.append(df)
        except AnalysisException as e:
            log.warning("skipping %s: %s", p, e.getCondition())
    return found


def rename_text(df: DataFrame) -> DataFrame:
    """text becomes transcript, where there is one."""
    return df.withColumnRenamed("text", "transcript")


def language_tag(language: Column, transcript: Column) -> Column:
    return F.concat(F.lit("<|"), language, F.lit("|><|transcribe|>"), transcript)


def concatenate(frames: list[DataFrame]) -> DataFrame:
    if not frames:
        raise ValueError("no data set to concatenate")
    return reduce(DataFrame.unionByName, frames)


def shuffle_key(sample_id: Column, seed: int = 42) -> Column:
    """Rows ordered by this are shuffled, alike in every run."""
    return F.md5(F.concat_ws(":", sample_id.cast("string"), F.lit(str(seed))))


def numbered(df: DataFrame, order: str, name: str, by: Column | None = None, parts: int = 256) -> DataFrame:
    """df with name: each row's position from 0 by order over the whole table. by: a number that never falls along order, where
    order isn't one. Rows are dealt into ranges of it and numbered in each, behind the sizes of the ranges before. df is read
    three times and must be the same each time; nulls come first, ties stand in any order."""
    by = F.col(order) if by is None else by
    cuts = sorted(set(df.agg(F.percentile_approx(by, [k / parts for k in range(1, parts)], 10_000)).first()[0] or []))
    dealt = df.withColumn("_part", F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= by)) if cuts else F.lit(0))
    sizes = dict(map(tuple, dealt.groupBy("_part").count().collect()))
    before = [sum(n for k, n in sizes.items() if k < part) for part in range(len(cuts) + 1)]
    offset = F.element_at(F.array(*(F.lit(n).cast("long") for n in before)), F.col("_part") + 1)
    return dealt.withColumn(name, offset + F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1).drop("_part")


def shuffled(df: DataFrame, sample_id: str, seed: int = 42) -> DataFrame:
    """All rows of df with key (shuffle_key) and pos, their place from 1 in the shuffled table."""
    keyed = numbered(df.withColumn("key", shuffle_key(F.col(sample_id), seed)), "key", "pos", by=F.conv(F.substring("key", 1, 15), 16, 10).cast("long"))
    return keyed.withColumn("pos", F.col("pos") + 1)


def batches(df: DataFrame, order: str, size: int, drop_last: bool = False) -> DataFrame:
    """df with batch: consecutive rows by their positions in order (a number, gaps allowed), `size` to a batch."""
    out = numbered(df, order, "batch").withColumn("batch", F.floor(F.col("batch") / size))
    return out.where(F.col("batch") < df.count() // size) if drop_last else out


def padded(df: DataFrame, column: str, value: float, batch: str = "batch") -> DataFrame:
    """df with the arrays of a column filled up behind with value to the longest of their batch; null arrays become all value."""
    longest = df.groupBy(batch).agg(F.max(F.coalesce(F.size(column), F.lit(0))).alias("_most"))
    kind = df.schema[column].dataType
    out = df.join(longest, batch)
    held = F.coalesce(F.col(column), F.array().cast(kind))
    fill = F.array_repeat(F.lit(value).cast(kind.elementType), F.greatest(F.col("_most") - F.size(held), F.lit(0)))
    return out.withColumn(column, F.concat(held, fill)).drop("_most")


def read_languages(spark: SparkSession, path: str) -> DataFrame:
    """code, language of a table of languages (CSV with a header)."""
    return spark.read.csv(path, header=True, schema="code string, language string")


def audio_files(spark: SparkSession, folder: str) -> DataFrame:
    """file, content of the audio files right in a folder."""
    names = ",".join([*AUDIO_EXTENSIONS, *(x.upper() for x in AUDIO_EXTENSIONS)])
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + names + "}").option("recursiveFileLookup", "false").load(folder).select(F.col("path").alias("file"), "content").orderBy("file")


def _samples(raw: bytes, width: int) -> np.ndarray:
    """PCM of 8 (unsigned), 16, 24 or 32 bits as floats in -1..1."""
    if width == 1:
        return (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
    if width == 3:
        wide = np.zeros((len(raw) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(raw, np.uint8)[: len(wide) * 3].reshape(-1, 3)
        return wide.view("<i4").ravel() / float(1 << 31)
    return np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]) / float(1 << (8 * width - 1))


def decode_wav(files: DataFrame, rate: int = 16_000) -> DataFrame:
    """PCM WAV content -> file, audio (mono floats, linearly resampled to rate), sample_rate; what can't be read has null audio.

    Other formats go through `transcribe` with a decoder of the user's."""
    def decode(raw: bytes) -> np.ndarray | None:
        try:
            with wave.open(io.BytesIO(raw)) as w:
                x = _samples(w.readframes(w.getnframes()), w.getsampwidth()).reshape(-1, w.getnchannels()).mean(axis=1)
                n = round(len(x) * rate / w.getframerate())
                return np.interp(np.arange(n) * w.getframerate() / rate, np.arange(len(x)), x).astype(np.float32) if len(x) else np.zeros(0, np.float32)
        except (wave.Error, EOFError, KeyError, ValueError):
            return None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"file": f["file"], "audio": [decode(x) for x in f["content"]], "sample_rate": rate})

    return files.select("file", "content").mapInPandas(run, "file string, audio array<float>, sample_rate int")


def duration(audio: Column, rate: Column) -> Column:
    return F.try_divide(F.size(audio).cast("double"), rate.cast("double"))


def transcribe(files: DataFrame, make, schema: str) -> DataFrame:
    """Run a transcriber over files: make() gives, once for each task, a function from a pandas frame to one of `schema`."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = make()
        for x in frames:
            yield f(x)

    return files.mapInPandas(run, schema)
