"""Operator parameters and fixed tables."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace

# The parameters' defaults.
@dataclass(frozen=True)
class Settings:
    batch_tokens: int = 1200
    max_batch_segments: int = 100
    tag_tokens: int = 12
    chars_per_token: float = 3.6
    max_completion_ratio: float = 3.0
    reasoning_headroom: int = 4000
    completion_pad: int = 512
    look_back: int = 2
    look_ahead: int = 1
    summary_every: int = 8
    min_score: float = 80.0
    completeness_floor: int = 70
    weights: dict[str, float] = field(default_factory=lambda: {"completeness": 0.35, "accuracy": 0.30, "terminology": 0.15, "fluency": 0.15, "formatting": 0.05})
    evaluation_sample: float = 1.0
    max_attempts: int = 3
    temperatures: tuple[float, ...] = (0.2, 0.3, 0.0)
    breaker_share: float = 0.25
    breaker_least: int = 8
    probe_pages: int = 3
    probe_skip_front: float = 0.10
    replacement_ratio: float = 0.02
    control_ratio: float = 0.02
    nonword_ratio: float = 0.35
    furniture_page_share: float = 0.25
    furniture_similarity: float = 0.9
    furniture_margin: float = 0.12
    paragraph_gap: float = 1.6
    drop_cap_ratio: float = 1.8
    footnote_ratio: float = 0.85
    heading_size_ratio: float = 1.15
    requests_per_minute: int = 60
    tokens_per_minute: int = 120_000
    backoff_first: float = 1.0
    backoff_most: float = 60.0
    retry_rate: float = 0.15
    review_threshold: float = 80.0
    report_limit: int = 200


DEFAULTS = Settings()

# Target tokens per source token by language, low and high.
EXPANSION = {
    "de": (1.05, 1.45), "nl": (1.05, 1.40), "fr": (1.10, 1.50), "es": (1.10, 1.50), "it": (1.05, 1.45), "pt": (1.10, 1.50),
    "ru": (0.95, 1.35), "pl": (0.95, 1.35), "ar": (0.90, 1.35), "fa": (0.95, 1.45), "ur": (0.95, 1.45), "he": (0.85, 1.25),
    "ja": (0.90, 1.60), "zh": (0.60, 1.10), "zh-hans": (0.60, 1.10), "zh-hant": (0.60, 1.10), "ko": (0.90, 1.50),
}
DEFAULT_EXPANSION = (0.85, 1.50)
# Token overheads of a call, completion tokens a judged segment, and the spread of the retry rate.
TRANSLATE_OVERHEAD, EVALUATE_OVERHEAD, JUDGE_TOKENS, RETRY_RANGE = 850, 700, 55, (0.4, 2.0)
# USD for a million prompt and completion tokens.
PRICES = {
    "anthropic/claude-sonnet-4.5": (3.00, 15.00),
    "anthropic/claude-opus-4.1": (15.00, 75.00),
    "anthropic/claude-haiku-4.5": (1.00, 5.00),
    "openai/gpt-4.1": (2.00, 8.00),
    "openai/gpt-4.1-mini": (0.40, 1.60),
    "openai/gpt-4o-mini": (0.15, 0.60),
    "google/gemini-2.5-flash": (0.30, 2.50),
    "google/gemini-2.5-pro": (1.25, 10.00),
    "deepseek/deepseek-chat": (0.28, 0.88),
    "meta-llama/llama-3.3-70b-instruct": (0.12, 0.30),
}
# Right-to-left languages and the report's score buckets (half-open).
RTL = ("ar", "fa", "he", "ur", "ps", "sd", "ug", "yi", "dv")
BUCKETS = ((0, 50), (50, 60), (60, 70), (70, 80), (80, 90), (90, 101))


def load(*layers: dict[str, object], env: dict[str, str] | None = None, prefix: str = "LEAFMILL_") -> Settings:
    """Settings from layers, the later over the earlier, then the environment; null never overrides.

    Text is read as its field's type; a name that isn't a field, or a value of another type, is an error.
    """
    kinds = {f.name: type(getattr(DEFAULTS, f.name)) for f in fields(Settings)}
    given: dict[str, object] = {}
    for layer in (*layers, {k.removeprefix(prefix).lower(): v for k, v in (env or {}).items() if k.startswith(prefix)}):
        given |= {k: v for k, v in layer.items() if v is not None}
    if unknown := set(given) - set(kinds):
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    out = {}
    for name, value in given.items():
        kind = kinds[name]
        if isinstance(value, str) and kind in (int, float):
            value = kind(value)
        if kind is float and isinstance(value, int) and not isinstance(value, bool):
            value = float(value)
        if not isinstance(value, kind):
            raise ValueError(f"{name} must be {kind.__name__}, not {value!r}")
        out[name] = value
    return replace(DEFAULTS, **out)
