"""Transcription results as text, JSON, SRT and VTT, and real-time factors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _clock(seconds: Column) -> tuple[Column, Column]:
    return F.floor(seconds / 3600).cast("int"), F.floor(seconds % 3600 / 60).cast("int")


def srt_time(seconds: Column) -> Column:
    h, m = _clock(seconds)
    return F.format_string("%02d:%02d:%02d,%03d", h, m, F.floor(seconds % 60).cast("int"), F.floor(seconds % 1 * 1000).cast("int"))


def vtt_time(seconds: Column) -> Column:
    h, m = _clock(seconds)
    return F.format_string("%02d:%02d:%06.3f", h, m, seconds % 60)


def _stripped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")


def _times(c: Column) -> tuple[Column, Column]:
    start = F.coalesce(c["start"], F.lit(0.0))
    return start, F.when(F.coalesce(c["end"], F.lit(0.0)) == 0, start + 1).otherwise(c["end"])


def as_srt(chunks: Column, text: Column) -> Column:
    def block(c: Column, i: Column) -> Column:
        start, end = _times(c)
        return F.concat((i + 1).cast("string"), F.lit("\n"), srt_time(start), F.lit(" --> "), srt_time(end), F.lit("\n"), _stripped(c["text"]), F.lit("\n"))

    return F.when(chunks.isNull(), text).otherwise(F.array_join(F.transform(chunks, block), "\n"))


def as_vtt(chunks: Column, text: Column) -> Column:
    def block(c: Column) -> Column:
        start, end = _times(c)
        return F.concat(vtt_time(start), F.lit(" --> "), vtt_time(end), F.lit("\n"), _stripped(c["text"]), F.lit("\n"))

    return F.concat(F.lit("WEBVTT\n\n"), F.when(chunks.isNull(), text).otherwise(F.array_join(F.transform(chunks, block), "\n")))


def formatted(results: DataFrame, kind: str) -> Column:
    if kind == "json":
        return F.to_json(F.struct(*results.columns), {"pretty": "true", "ignoreNullFields": "false"})
    if kind == "srt":
        return as_srt(F.col("chunks"), F.col("text"))
    if kind == "vtt":
        return as_vtt(F.col("chunks"), F.col("text"))
    return F.col("text")


def append_text(results: DataFrame, kind: str, path: str) -> None:
    """Formatted results as text files that follow each other, and hold their results, in the order of `file`."""
    ordered = results.withColumn("value", formatted(results, kind)).repartitionByRange("file").sortWithinPartitions("file")
    ordered.select("value").write.mode("append").text(path)


def show_text(results: DataFrame, kind: str, out=None) -> None:
    """Formatted results to a text stream (standard output), in the order of `file`; one partition at a time is held."""
    import sys

    into = out or sys.stdout
    for row in results.withColumn("value", formatted(results, kind)).orderBy("file").select("value").toLocalIterator():
        print(row["value"], file=into)


def rtf(inference: Column, audio: Column) -> Column:
    return F.try_divide(inference, audio)


def rtf_summary(results: DataFrame) -> DataFrame:
    return results.agg(F.count("*").alias("files"), F.sum("audio_duration").alias("audio"), F.sum("inference_time").alias("inference"), F.try_divide(F.sum("inference_time"), F.sum("audio_duration")).alias("rtf"))
