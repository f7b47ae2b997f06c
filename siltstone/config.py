"""Options with their defaults; environment variables of the same names override them."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    """Defaults that define results. ``until`` empty means today."""

    categories: tuple[str, ...] = ("cs.LG", "cs.CL")
    max_results: int = 500
    since: str = "2024-01-01"
    until: str = ""
    min_section_chars: int = 50
    chunk_size: int = 512
    chunk_overlap: int = 64
    breakpoint_percentile: float = 95.0
    vocabulary: str = ""  # a file of byte-pair ranks; empty: the lossless tokenizer
    token_pattern: str = "100k"
    rrf_k: int = 60
    fan_out: int = 50
    top_k: int = 10
    n_rewrites: int = 3
    context_k: int = 3
    context_chars: int = 1500
    quote_min_chars: int = 15
    ann_min_rows: int = 50_000
    min_chunk_tokens: int = 100
    min_question_chars: int = 15
    min_answer_chars: int = 20
    min_confidence: float = 0.6
    n_reverse: int = 3
    call_tasks: int = 8
    calls_at_once: int = 8
    call_tries: int = 5
    call_wait: float = 1.0


def load_settings(env: Mapping[str, str] | None = None, dotenv: str | None = ".env") -> Settings:
    """Defaults, overridden by the lines ``NAME=value`` of ``dotenv`` and then by ``env``; names in any case, unknown ones ignored."""
    given: dict[str, str] = {}
    if dotenv and os.path.exists(dotenv):
        with open(dotenv) as f:
            given |= {k.strip().lower(): v.strip().strip("\"'") for k, _, v in (line.partition("=") for line in f if "=" in line and not line.lstrip().startswith("#"))}
    given |= {k.lower(): v for k, v in (os.environ if env is None else env).items()}
    base, changed = Settings(), {}
    for f in fields(Settings):
        if f.name in given:
            kind, raw = type(getattr(base, f.name)), given[f.name]
            changed[f.name] = tuple(x.strip() for x in raw.strip("[]").replace('"', "").split(",") if x.strip()) if kind is tuple else kind(raw)
    return replace(base, **changed)
