"""The facade: fit, score, select, run, analyse, save and load."""

from __future__ import annotations

import json
from dataclasses import asdict, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import AcousticConfig, CurationConfig, LinguisticConfig, MutualInfoConfig, ProgressiveConfig, ScorerConfig, SelectorConfig
from ..functions.signal import acoustic_entropy, spectral_centroid
from ..functions.text import text_of
from ..operators import features as X
from ..operators.cells import CellInformation
from ..operators.progressive import CurationStats, filter_rounds, filter_with_callbacks
from ..operators.scoring import ScorerModel, analyze, score_percentiles
from ..operators.selection import select
from ..operators.shuffles import settled


def mi_features(df: DataFrame, feature_type: str = "combined") -> dict[str, F.Column]:
    """The features whose joint distribution tells how rare a sample is: linguistic, acoustic or combined. A table without
    audio has linguistic ones only."""
    if feature_type not in ("linguistic", "acoustic", "combined"):
        raise ValueError(f"unknown feature type {feature_type}: linguistic, acoustic or combined")
    audio, made = "audio" in df.columns, {}
    if feature_type != "acoustic":
        made |= X.mi_text_features(text_of())
    if feature_type != "linguistic" and audio:
        made |= X.mi_signal_features(F.col("audio"), F.col("sample_rate")) | {"centroid": spectral_centroid(F.col("audio"))}
    if not made:
        raise ValueError("acoustic features need a column audio")
    return made


class CurationPipeline:
    """Scores samples (sample_id, sample_ord, transcription, optionally audio, sample_rate, language) and keeps the informative ones.

    frequencies (token, freq) of a reference corpus switch the bonus for rare words on."""

    def __init__(self, config: CurationConfig = CurationConfig(), frequencies: DataFrame | None = None):
        self.config, self.model, self.cells = config, None, None
        self.common = None if frequencies is None else X.common_tokens(frequencies, config.linguistic)

    def get_config(self) -> dict:
        return asdict(self.config)

    def components(self, df: DataFrame) -> DataFrame:
        """df with a column for each component that is switched on. Without audio the acoustic one is 0."""
        on, audio = self.config.scorer, "audio" in df.columns
        out = df
        if on.use_linguistic or on.use_phonetic or on.use_contextual:
            out = X.text_components(out, self.config.linguistic, common=self.common)
        if on.use_acoustic:
            out = out.withColumn("acoustic", acoustic_entropy(F.col("audio"), self.config.acoustic) if audio else F.lit(0.0))
        if on.use_mutual_info:
            made = mi_features(df, self.config.mutual_info.feature_type)
            out = settled(out.withColumns(made))
            self.cells = self.cells or CellInformation.fit(out, tuple(made), self.config.mutual_info.bins)
            out = self.cells.transform(out).drop(*made)
        return out

    def fit(self, df: DataFrame) -> CurationPipeline:
        self.cells = None
        self.model = ScorerModel.fit(self.components(df), self.config.scorer)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return self.score(df)

    def score(self, df: DataFrame) -> DataFrame:
        if self.model is None:
            self.fit(df)
        return self.model.transform(self.components(df))

    def score_detailed(self, df: DataFrame) -> DataFrame:
        if self.model is None:
            self.fit(df)
        return self.model.detailed(self.components(df))

    def select_single_round(self, df: DataFrame, threshold: float | None = None, percentile: float | None = None, top_k: int | None = None) -> DataFrame:
        if threshold is not None:
            how = SelectorConfig("threshold", threshold=threshold)
        elif percentile is not None:
            how = SelectorConfig("percentile", percentile=percentile)
        elif top_k is not None:
            how = SelectorConfig("top_k", top_k=top_k)
        else:
            how = SelectorConfig("threshold", threshold=self.config.progressive.initial_threshold)
        return select(settled(self.score(df)), how)

    def run(self, df: DataFrame, train=None, evaluate=None, known_languages: list[str] | None = None) -> tuple[DataFrame, CurationStats]:
        """The rounds of progressive filtering; an empty table gives no rounds. Rounds are settled tables."""
        scored = settled(self.score(df))
        if train or evaluate or known_languages:
            return filter_with_callbacks(scored, self.config.progressive, train, evaluate, known_languages)
        return filter_rounds(scored, self.config.progressive)

    def analyze_dataset(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        scored = settled(self.score(df))
        return analyze(scored, [*self.config.scorer.weights(), "score"]), score_percentiles(scored)

    def set_weights(self, **weights: float) -> None:
        self.config = replace(self.config, scorer=replace(self.config.scorer, **weights))
        if self.model is not None:
            self.model = replace(self.model, config=self.config.scorer)

    def save(self, spark, path: str) -> None:
        """The settings and all that was fitted, as one JSON text in any store Spark writes to."""
        held = {"config": asdict(self.config), "common": self.common, "stats": self.model and self.model.stats, "cells": self.cells and asdict(self.cells)}
        spark.createDataFrame([(json.dumps(held),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @staticmethod
    def load(spark, path: str) -> CurationPipeline:
        held = json.loads("".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))
        c, kinds = held["config"], {"scorer": ScorerConfig, "progressive": ProgressiveConfig, "linguistic": LinguisticConfig, "mutual_info": MutualInfoConfig, "acoustic": AcousticConfig}
        out = CurationPipeline(CurationConfig(**{k: kinds[k](**v) for k, v in c.items()}))
        out.common = held["common"]
        out.model = held["stats"] and ScorerModel(out.config.scorer, held["stats"])
        if held["cells"]:
            out.cells = CellInformation(**(held["cells"] | {"names": tuple(held["cells"]["names"])}))
        return out
