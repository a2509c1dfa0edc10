"""Settings, read from the environment once and passed on as plain values."""

from __future__ import annotations

import os
from dataclasses import dataclass, field


def _int(name: str, default: int) -> int:
    try:
        return int(os.environ.get(name, default))
    except ValueError:
        return default


@dataclass(frozen=True)
class TopK:
    """Number of passages after reranking: fixed (1 to 64), or by question up to ``most``."""

    default: int = 16
    most: int = 32
    fixed: int | None = None

    def __post_init__(self) -> None:
        object.__setattr__(self, "default", max(1, self.default))
        object.__setattr__(self, "most", max(1, self.most))


@dataclass(frozen=True)
class Settings:
    """All knobs of the pipeline; ``from_env`` reads ``TIDEMARK_*`` variables."""

    topk: TopK = field(default_factory=TopK)
    candidates: int = 64
    chunk_chars: int = 1800
    chunk_overlap: int = 200
    lookback_minutes: int = 90
    excerpt_bytes: int = 1500
    upsert_batch: int = 64
    api_url: str = "http://localhost:5191"
    api_token: str | None = None
    source_url: str | None = None
    source_headers: str = "{}"
    store: str | None = None
    store_buckets: int = 32
    model_url: str | None = None
    model_key: str = ""
    chat_model: str = "chat"
    embedding_model: str = "embedding"
    plan_with_model: bool = False

    @classmethod
    def from_env(cls) -> Settings:
        fixed = os.environ.get("TIDEMARK_TOPK_FIXED")
        return cls(
            topk=TopK(_int("TIDEMARK_TOPK_DEFAULT", 16), _int("TIDEMARK_TOPK_MAX", 32), int(fixed) if fixed and fixed.lstrip("-").isdigit() else None),
            candidates=_int("TIDEMARK_CANDIDATES", 64),
            lookback_minutes=_int("TIDEMARK_LOOKBACK_MINUTES", 90),
            api_url=os.environ.get("TIDEMARK_API_URL", "http://localhost:5191"),
            api_token=os.environ.get("TIDEMARK_API_TOKEN"),
            source_url=os.environ.get("TIDEMARK_SOURCE_URL"),
            source_headers=os.environ.get("TIDEMARK_SOURCE_HEADERS", "{}"),
            store=os.environ.get("TIDEMARK_STORE"),
            store_buckets=_int("TIDEMARK_STORE_BUCKETS", 32),
            model_url=os.environ.get("TIDEMARK_MODEL_URL"),
            model_key=os.environ.get("TIDEMARK_MODEL_KEY", ""),
            chat_model=os.environ.get("TIDEMARK_CHAT_MODEL", "chat"),
            embedding_model=os.environ.get("TIDEMARK_EMBEDDING_MODEL", "embedding"),
            plan_with_model=os.environ.get("TIDEMARK_PLAN_WITH_MODEL", "").lower() in ("1", "true", "yes"),
        )
