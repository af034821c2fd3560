"""Settings from an environment-like mapping, checked where they are used."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields


# Names of the application's variables where they are not those of the fields in upper case.
NAMES = {"api_key": "DEEPINFRA_API_KEY", "base_url": "DEEPINFRA_BASE_URL", "store_host": "QDRANT_HOST", "store_key": "QDRANT_API_KEY", "collection": "QDRANT_COLLECTION", "rerank_model": "RERANKED_MODEL"}


@dataclass(frozen=True)
class Settings:
    """Models, store and limits. A mapping names them by the fields in upper case or as in NAMES."""

    # fixed values: the application's defaults, but for the collection's name
    embedding_model: str = "BAAI/bge-m3-multi"
    api_key: str = ""
    base_url: str = "https://api.deepinfra.com/v1"
    store_host: str = "http://localhost:6333"
    store_key: str = ""
    collection: str = "chunks"
    embedding_batch_size: int = 8
    http_timeout_seconds: float = 120.0
    rerank_model: str = "Qwen/Qwen3-Reranker-4B"
    generative_model: str = "Qwen/Qwen3-32B"
    retrieval_limit: int = 20
    rerank_top_k: int = 7
    rrf_k: int = 60
    rerank_min_score: float = 0.05
    generation_max_tokens: int = 8192

    @classmethod
    def of(cls, env: Mapping[str, str]) -> Settings:
        """Blank values take the default, addresses lose a final slash, whole numbers must be above zero."""
        out = {}
        for f in fields(cls):
            raw = (env.get(f.name.upper()) or env.get(NAMES.get(f.name, "")) or "").strip()
            if not raw:
                continue
            value = type(f.default)(raw.rstrip("/") if f.name in ("base_url", "store_host") else raw)
            if isinstance(f.default, int) and value <= 0:
                raise ValueError(f"{f.name} must be above zero")
            out[f.name] = value
        return cls(**out)

    def _require(self, *names: str) -> Settings:
        for name in names:
            if not getattr(self, name):
                raise ValueError(f"{name} is required")
        if self.http_timeout_seconds <= 0:
            raise ValueError("http_timeout_seconds must be above zero")
        return self

    def check_indexing(self) -> Settings:
        return self._require("embedding_model", "api_key", "store_host", "collection")

    def check_scope(self) -> Settings:
        return self._require("api_key", "generative_model")

    def check_query(self) -> Settings:
        """What answering needs besides indexing: models and ranges."""
        self.check_indexing()._require("rerank_model", "generative_model", "retrieval_limit", "rerank_top_k", "rrf_k")
        if self.rerank_min_score < 0:
            raise ValueError("rerank_min_score must be at least 0")
        if not 1 <= self.generation_max_tokens <= 40960:
            raise ValueError("generation_max_tokens must be from 1 to 40960")
        return self
