"""Settings of the engine. The defaults are fixed values that results depend on."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class ChunkConfig:
    target_tokens: int = 350
    max_tokens: int = 512
    min_tokens: int = 64
    overlap_sentences: int = 1


@dataclass(frozen=True)
class FusionWeights:
    dense: float = 1.0
    heading: float = 0.7
    path: float = 0.8
    category: float = 0.3
    bm25: float = 0.5
    entity: float = 0.2
    graph: float = 0.3


@dataclass(frozen=True)
class GateConfig:
    """A token is rare where its document frequency is at most (1 - quantile) of all documents."""

    quantile: float = 0.85
    penalty: float = 0.3
    no_tokens: float = 0.7


@dataclass(frozen=True)
class SearchConfig:
    semantic_top_k: int = 180
    oversample: int = 5
    top_k_docs: int = 5
    max_chunks_per_doc: int = 4
    weights: FusionWeights = field(default_factory=FusionWeights)
    gate: GateConfig = field(default_factory=GateConfig)


@dataclass(frozen=True)
class RerankConfig:
    kind: str = "hybrid"
    alpha: float = 0.7
    hierarchy_weight: float = 0.3
    coherence_weight: float = 0.1
    early_stopping: float = 0.3
    max_candidates: int = 100
    max_page_gap: int = 2


@dataclass(frozen=True)
class ContextConfig:
    token_budget: int = 2000
    items_per_section: int = 2


@dataclass(frozen=True)
class GraphConfig:
    damping: float = 0.85
    iterations: int = 20
    max_distance: int = 2
    expand_from: int = 5
    expand_decay: float = 0.7
    expand_least: float = 0.1
    fewest_candidates: int = 5
