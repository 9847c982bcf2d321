"""Settings of a forecast as plain values; presets for common uses."""

from __future__ import annotations

import os
from dataclasses import dataclass, replace

#: Providers whose answers come with probabilities.
PROVIDERS_WITH_LABELS = ("openai", "groq")
FILTER_MODES = ("none", "static", "time-aware")


def truthy(value: str | None, default: bool = False) -> bool:
    """1, true, yes and on mean true; nothing at all means the default."""
    return default if value is None or not value.strip() else value.strip().lower() in {"1", "true", "yes", "on"}


def filter_mode(raw: str | None) -> str:
    """One of FILTER_MODES, by name; empty means none."""
    mode = (raw or "none").strip().lower().replace("_", "-")
    if mode not in FILTER_MODES:
        raise ValueError(f"unknown filter mode {raw!r}; one of {', '.join(FILTER_MODES)}")
    return mode


def label_scores(env: dict[str, str]) -> bool:
    """Whether answers are picked by label scores: as told, else as the provider can."""
    told = env.get("USE_LOGPROB_PREDICTION", "")
    return truthy(told) if told.strip() else env.get("LLM_PROVIDER", "openai").strip().lower() in PROVIDERS_WITH_LABELS


def numbers(text: str | None, default: tuple, kind=int) -> tuple:
    """A list of numbers between commas; nothing at all means the default."""
    return tuple(kind(x) for x in text.split(",") if x.strip()) if text and text.strip() else default


#: Names of settings in an environment and their defaults are fixed values: users' environments hold them.
@dataclass(frozen=True)
class Settings:
    """short: l; total: L; alpha: the threshold's exponent; day_cap, event_cap: newest days and last events of a day (0: all)."""

    short: int = 20
    total: int = 100
    alpha: float = 2.75
    day_cap: int = 0
    event_cap: int = 64
    use_short: bool = True
    use_long: bool = True
    use_analogies: bool = True
    analogies: int = 1
    min_contexts: int = 300
    min_history: int | None = None
    second_order: bool = False
    adaptive: bool = False
    min_candidates: int = 3
    confidence: float = 0.0
    max_scored: int = 512
    chunk: int = 32
    filter: str = "none"
    label_scores: bool = True

    @property
    def least_history(self) -> int:
        """Shortest dual history of a similar event: L, or less if days are capped."""
        if self.min_history is not None:
            return self.min_history
        return max(self.short, self.short + self.day_cap // 2) if self.day_cap else self.total

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Settings:
        e = os.environ if env is None else env
        number = lambda name, default, kind=int: kind(e[name]) if e.get(name, "").strip() else default
        return cls(
            short=number("SHORT_TERM_L", 20), total=number("HISTORY_LENGTH_L", 100), alpha=number("DTF_ALPHA", 2.75, float),
            day_cap=number("MAX_DTF_TIMESTEP_ITERATIONS", 0), event_cap=number("LLM_SCORE_MAX_EVENTS_PER_TIMESTEP", 64),
            use_short=not truthy(e.get("DISABLE_SHORT_TERM")), use_long=not truthy(e.get("DISABLE_LONG_TERM")),
            analogies=number("NUM_ANALOGICAL_EXAMPLES", 1), min_contexts=number("MIN_HISTORY_CONTEXTS", 300),
            second_order=truthy(e.get("USE_SECOND_ORDER_CANDIDATES")), adaptive=truthy(e.get("ADAPTIVE_CANDIDATES")),
            min_candidates=number("ADAPTIVE_MIN_CANDIDATES", 3), confidence=number("ADAPTIVE_CONFIDENCE_THRESHOLD", 0.0, float), filter=filter_mode(e.get("EVAL_FILTER")),
            max_scored=number("MAX_LOGPROB_CANDIDATES", 512), chunk=number("LLM_SCORE_CHUNK_SIZE", 32),
            min_history=number("MIN_SIMILAR_HISTORY_LENGTH", None), label_scores=label_scores(e),
        )


DEFAULT = Settings()
INTERACTIVE = replace(DEFAULT, day_cap=40, adaptive=True, chunk=24, label_scores=False)
METRICS = replace(INTERACTIVE, day_cap=10, event_cap=32, chunk=16)
FAST = replace(DEFAULT, short=10, total=40, day_cap=15, event_cap=32, chunk=12, label_scores=False)
