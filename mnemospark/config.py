"""Parameters of scoring and maintenance. Results depend on them, so they are stated as they are."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Scoring:
    # Reciprocal rank fusion: weight and offset of each channel.
    vector_weight: float = 0.505
    vector_k: float = 6.845
    keyword_k: float = 8.002
    theme_weight: float = 0.116
    theme_k: float = 4.924
    related_k: float = 6.0
    # Keyword channel: field weights, and the constants of BM25.
    summary_weight: float = 13.278
    themes_weight: float = 5.731
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    # Feedback: smoothing, exploration, and the prior where feedback doesn't give one.
    ewma_alpha: float = 0.431
    ucb: float = 0.84
    prior_mean: float = 0.25
    prior_strength: float = 1.0
    prior_least_memories: int = 5
    # Co-retrieval.
    hebbian: float = 0.001746
    hebbian_cap: float = 0.275
    hebbian_joint: int = 2
    hebbian_queries: int = 5
    hebbian_seeds: int = 5
    # Spreading activation.
    ppr_damping: float = 0.216
    ppr_boost: float = 1.591
    ppr_seeds: int = 5
    ppr_new: int = 20
    ppr_steps: int = 12

    @property
    def keyword_weight(self) -> float:
        return 1.0 - self.vector_weight


@dataclass(frozen=True)
class Maintenance:
    decay_rates: dict[str, float] = field(default_factory=lambda: {"entity": 0.0, "meta": 0.004, "reflection": 0.006, "semantic": 0.008, "procedural": 0.012, "episodic": 0.023})
    decay_default: float = 0.008
    decay_floor: float = 0.35
    useful: float = 0.5
    useless: float = 0.1
    growth: float = 0.08
    shrink: float = 0.07
    confidence_start: float = 0.5
    confidence_low: float = 0.1
    confidence_high: float = 0.95
    edge_up: float = 0.02
    edge_down: float = 0.01
    pending_days: int = 14
    archive_days: int = 90
    dedup_distance: float = 0.1


SCORING = Scoring()
MAINTENANCE = Maintenance()
