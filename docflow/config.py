"""Parameters of the operators. Those of the data platform whose results these queries give."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ChunkConfig:
    target_tokens: int = 340
    min_tokens: int = 50
    overlap: float = 0.20
    soft_max: int = 450
    hard_max: int = 512
    force_split_safety: float = 0.9
    look_ahead_chars: int = 100
    keep_tail: bool = True


@dataclass(frozen=True)
class SearchConfig:
    k: int = 10
    multiplier: int = 10
    min_similarity: float = 0.0
    max_context_tokens: int = 4000
    #: Queries that may be broadcast; beyond it the join is shuffled.
    max_broadcast_queries: int = 10_000


@dataclass(frozen=True)
class IndexConfig:
    """Cells of the inverted-file index and how many of them a query probes."""

    n_cells: int = 128
    n_probe: int = 32
    seed: int = 42


INDEX_PROFILES = {"development": IndexConfig(128, 32), "production": IndexConfig(1024, 64), "testing": IndexConfig(1, 1)}
HISTORY_LENGTH = 100
EVALUATION_DEPTHS = (1, 3, 5, 10, 20)
