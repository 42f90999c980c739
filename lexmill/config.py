"""Settings with their defaults and constraints."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from .errors import ConfigurationError
from .operators.search import Settings as SearchSettings

BREAKS = ("percentile", "standard_deviation", "interquartile", "gradient")


@dataclass(frozen=True)
class Config:
    chunk_size: int = 1000
    chunk_overlap: int = 200
    min_chunk_size: int = 0
    chunker: str = "header"
    vector_search_k: int = 5
    supported_extensions: tuple[str, ...] = (".pdf", ".md", ".markdown")
    enable_hybrid_search: bool = True
    vector_weight: float = 0.6
    text_weight: float = 0.4
    rrf_k: int = 60
    expansion_factor: float = 2.0
    max_expanded_limit: int = 30
    text_analyzer: str = "standard"
    text_min_score: float = 0.0
    semantic_threshold: str = "percentile"
    semantic_amount: float = 95.0
    semantic_buffer: int = 1
    semantic_min_chars: int = 100
    page_min_chunk_size: int = 100
    page_max_chunk_size: int | None = None
    page_merge_small: bool = True
    pdf_parser: str = "none"  # names the parser and embedder that are passed to the knowledge base, for the fingerprints
    embedder: str = "hashed-64"
    max_parallel_parsing: int | None = None  # tasks that parse, or embed, at once
    max_parallel_embedding: int | None = None
    rerank: bool = False
    rerank_additional: int = 5
    summarise: bool = False
    summary_max_pages: int = 10
    scope: bool = True
    scope_threshold: int = 1000
    scope_documents: int = 50
    scope_seconds: int = 3600

    def __post_init__(self):
        def need(holds: bool, text: str) -> None:
            if not holds:
                raise ConfigurationError(text)

        need(self.chunk_size > 0, "chunk_size must be positive")
        need(0 <= self.chunk_overlap < self.chunk_size, "chunk_overlap must be below chunk_size")
        need(self.min_chunk_size >= 0, "min_chunk_size must not be negative")
        need(self.vector_search_k > 0, "vector_search_k must be positive")
        need(abs(self.vector_weight + self.text_weight - 1) <= 0.001, "the weights must add up to 1")
        need(self.rrf_k > 0, "rrf_k must be positive")
        need(0 <= self.text_min_score <= 1, "text_min_score must lie between 0 and 1")
        need(self.text_analyzer in ("standard", "stemming"), "text_analyzer is standard or stemming")
        need(self.semantic_threshold in BREAKS, "unknown semantic_threshold")
        for name in ("max_parallel_parsing", "max_parallel_embedding"):
            need(getattr(self, name) is None or getattr(self, name) > 0, f"{name} must be positive")
        need(self.page_max_chunk_size is None or self.page_max_chunk_size > self.page_min_chunk_size, "page_max_chunk_size must exceed page_min_chunk_size")

    @staticmethod
    def from_environment(prefix: str = "LEXMILL_", environment: dict[str, str] | None = None) -> Config:
        """Settings from variables named prefix + the setting in capitals."""
        env, given = os.environ if environment is None else environment, {}
        for f in fields(Config):
            raw = env.get(prefix + f.name.upper())
            if raw is None:
                continue
            default = f.default
            if isinstance(default, bool):
                given[f.name] = raw.strip().lower() in ("1", "true", "yes", "on")
            elif isinstance(default, tuple):
                given[f.name] = tuple(x.strip() for x in raw.split(",") if x.strip())
            elif isinstance(default, float):
                given[f.name] = float(raw)
            elif isinstance(default, int) or default is None:  # optional settings are numbers
                given[f.name] = int(raw)
            else:
                given[f.name] = raw
        return Config(**given)

    def search_settings(self) -> SearchSettings:
        return SearchSettings(
            self.vector_weight, self.text_weight, self.rrf_k, self.expansion_factor, self.max_expanded_limit, self.rerank_additional, self.scope_threshold, self.scope_documents, self.scope_seconds
        )

    def stage_settings(self) -> dict[str, dict]:
        """All settings that affect each stage: what its fingerprint covers."""
        pick = lambda *names: {n: getattr(self, n) for n in names}
        return {
            "parsing": pick("supported_extensions", "pdf_parser"),
            "chunking": pick(
                "chunker", "chunk_size", "chunk_overlap", "min_chunk_size", "semantic_threshold", "semantic_amount", "semantic_buffer", "semantic_min_chars",
                "page_min_chunk_size", "page_max_chunk_size", "page_merge_small",
            ),
            "embedding": pick("embedder"),
            "summarizer": pick("summarise", "summary_max_pages"),
        }
