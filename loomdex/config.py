"""Settings. The defaults are fixed values of the retrieval semantics."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class RetrievalConfig:
    per_engine: int = 100
    final_k: int = 3
    rrf_k: int = 60
    weight_all: float = 1.0
    weight_any: float = 0.5
    semantic_floor: float = 0.15
    semantic_ceiling: float = 0.5
    ramp_words: int = 8
    k1: float = 1.5
    b: float = 0.75
    delta: float = 1.0
    min_word: int = 4
    score_cutoff: float = 80.0
    ascii_edges: bool = False


@dataclass(frozen=True)
class ChunkerConfig:
    window: int = 16
    overlap_threshold: float = 0.3
    gap_lines: int = 1
    min_chars: int = 1500
    max_chars: int = 6000
    refine: bool = True
    embedding_window: int = 16
    embedding_batch: int = 32
    competition: int = 400
    hard_confidence: float = 0.65
    lexical_weight: float = 0.35
    embedding_weight: float = 0.55
    gap_weight: float = 0.1


@dataclass(frozen=True)
class IngestConfig:
    overlap_chars: int = 200
    embed_batch: int = 8
    min_transcript: int = 20
    blog_base: str = "https://example.org/blog/"
    watch_base: str = "https://www.youtube.com/watch?v="
    drop_section: str = ""


@dataclass(frozen=True)
class GenerationConfig:
    model: str = "local"
    temperature: float = 0.1
    top_p: float = 0.95
    top_k: int = 5
    max_tokens: int = 1500


def from_env(kind, prefix: str = "LOOMDEX_"):
    """An instance of ``kind`` with fields taken from PREFIX + NAME where set."""
    got = {}
    for f in fields(kind):
        raw = os.environ.get(prefix + f.name.upper())
        if raw is not None:
            got[f.name] = raw.lower() in ("1", "true", "yes") if isinstance(f.default, bool) else type(f.default)(raw)
    return kind(**got)
