"""Settings and their defaults."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Config:
    # fixed values
    cost_threshold: int = 100_000
    recall_decay: float = 0.5912428069710964
    remember_weights: list[float] = field(default_factory=lambda: [0.52, 0.25, 0.15, 0.08])
    fusion_method: str = "weighted"
    rrf_k: int = 60
    recency_half_life_days: float = 7300.0
    search_oversample: int = 16
    similar_limit: int = 10
    chunk_size: int = 2000
    chunk_overlap: int = 50
    summary_chars: int = 200
    duplicate_threshold: float = 0.95
    connect_threshold: float = 0.85
    connect_node_threshold: float = 0.8
    consolidate_threshold: float = 0.7
    warm_days: int = 30
    archive_days: int = 90
    delete_days: int = 365
    paths_cap: int = 100
    protected_kinds: tuple[str, ...] = ("schema", "config", "system")
    stemming: bool = True
    graph_signal: bool = False
    sentence_nodes: bool = True
    ceiling_mb: int = 256
    reader_timeout_s: float = 30.0
