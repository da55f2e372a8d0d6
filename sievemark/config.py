"""Settings with their defaults, and the fixed tables of the text features."""

from __future__ import annotations

from dataclasses import dataclass, field

EPSILON = 1e-10


@dataclass(frozen=True)
class ScorerConfig:
    acoustic_weight: float = 0.25
    phonetic_weight: float = 0.20
    linguistic_weight: float = 0.25
    contextual_weight: float = 0.15
    mi_weight: float = 0.15
    normalize: bool = True
    normalization: str = "minmax"
    use_acoustic: bool = True
    use_phonetic: bool = True
    use_linguistic: bool = True
    use_contextual: bool = True
    use_mutual_info: bool = True

    def weights(self) -> dict[str, float]:
        every = {"acoustic": (self.use_acoustic, self.acoustic_weight), "phonetic": (self.use_phonetic, self.phonetic_weight), "linguistic": (self.use_linguistic, self.linguistic_weight), "contextual": (self.use_contextual, self.contextual_weight), "mutual_info": (self.use_mutual_info, self.mi_weight)}
        return {k: w for k, (on, w) in every.items() if on}


@dataclass(frozen=True)
class ProgressiveConfig:
    initial_threshold: float = 0.3
    growth_factor: float = 1.1
    min_samples: int = 1000
    min_fraction: float = 0.1
    max_rounds: int = 10
    diversity: float = 0.05
    error_weight: float = 0.3
    error_analysis: bool = True
    cross_lingual_weight: float = 0.2
    seed: int = 42


@dataclass(frozen=True)
class SelectorConfig:
    mode: str = "threshold"
    threshold: float = 0.5
    percentile: float = 50.0
    top_k: int = 1000


@dataclass(frozen=True)
class AcousticConfig:
    n_bands: int = 13
    n_fft: int = 512
    hop: int = 160
    n_bins: int = 64


@dataclass(frozen=True)
class LinguisticConfig:
    mode: str = "word"
    bigram_weight: float = 0.5
    rare_threshold: float = 0.001
    rare_bonus: float = 0.1
    use_bigrams: bool = True


@dataclass(frozen=True)
class MutualInfoConfig:
    feature_type: str = "combined"  # linguistic, acoustic or combined
    bins: int = 32
    smoothing: float = 1e-10


@dataclass(frozen=True)
class CurationConfig:
    scorer: ScorerConfig = field(default_factory=ScorerConfig)
    linguistic: LinguisticConfig = field(default_factory=LinguisticConfig)
    mutual_info: MutualInfoConfig = field(default_factory=MutualInfoConfig)
    acoustic: AcousticConfig = field(default_factory=AcousticConfig)
    progressive: ProgressiveConfig = field(default_factory=ProgressiveConfig)


# Domains with their keywords.
DOMAINS = {
    "conversational": ["yeah", "okay", "like", "um", "uh", "gonna"],
    "broadcast": ["news", "report", "today", "announced", "according"],
    "telephony": ["hello", "speaking", "call", "phone"],
    "lecture": ["chapter", "example", "equation", "concept", "theory"],
    "medical": ["patient", "diagnosis", "treatment", "symptoms", "doctor"],
    "legal": ["court", "defendant", "plaintiff", "verdict", "judge"],
    "financial": ["market", "earnings", "revenue", "quarter", "growth"],
    "technical": ["system", "data", "algorithm", "process", "function"],
    "spontaneous": ["well", "so", "actually", "basically"],
    "read_speech": [],
    "multilingual": [],
    "noisy": [],
    "other": [],
}
# Discourse markers.
MARKERS = ["um", "uh", "er", "ah", "like", "you know", "i mean", "so", "well", "now", "then", "anyway", "however", "therefore", "maybe", "perhaps", "kind of", "sort of", "probably", "right", "okay", "yeah", "yes", "no", "actually", "basically"]
# Phonemes by letter; a blank is silence.
LETTER_PHONEMES = {
    "a": "AH", "b": "B", "c": "K", "d": "D", "e": "EH",
    "f": "F", "g": "G", "h": "HH", "i": "IH", "j": "JH",
    "k": "K", "l": "L", "m": "M", "n": "N", "o": "OW",
    "p": "P", "q": "K", "r": "R", "s": "S", "t": "T",
    "u": "UW", "v": "V", "w": "W", "x": "K", "y": "Y",
    "z": "Z", " ": "SIL",
}
N_PHONEMES = 41
# Language families.
FAMILIES = {"germanic": ["en", "de", "nl", "sv", "da", "no"], "romance": ["es", "fr", "it", "pt", "ro"], "slavic": ["ru", "pl", "cs", "uk", "bg"], "indic": ["hi", "bn", "mr", "ta", "te", "gu"], "sino_tibetan": ["zh", "yue", "my"], "semitic": ["ar", "he", "am"]}
#: Languages taken as known where a query needs some.
COMMON_LANGUAGES = ["en", "de"]
