"""Settings of an engine, also read from the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConf:
    index_dir: str | None = None
    dump_path: str | None = None
    corpus_size: int = 0  # articles at most; 0 takes all
    cache_size: int = 1024
    k1: float = 1.2
    b: float = 0.75
    shards: tuple[str, ...] = ("shard-0", "shard-1", "shard-2")
    replicas: int = 1000
    connect_timeout: float = 0.2
    read_timeout: float = 2.0
    breaker_threshold: int = 3
    breaker_cooldown: float = 10.0

    @property
    def budget(self) -> float:
        """Seconds after which an answer counts as failed."""
        return self.connect_timeout + self.read_timeout + 1.0

    @classmethod
    def from_env(cls, env: Mapping[str, str] = os.environ) -> EngineConf:
        names = {
            "index_dir": "SEARCH_INDEX_DIR", "dump_path": "SEARCH_DUMP_PATH", "corpus_size": "SEARCH_CORPUS_SIZE", "cache_size": "SEARCH_CACHE_SIZE",
            "connect_timeout": "SHARD_CONNECT_TIMEOUT", "read_timeout": "SHARD_READ_TIMEOUT", "breaker_threshold": "BREAKER_FAILURE_THRESHOLD",
            "breaker_cooldown": "BREAKER_COOLDOWN_SECONDS",
        }
        kinds = {"corpus_size": int, "cache_size": int, "breaker_threshold": int, "connect_timeout": float, "read_timeout": float, "breaker_cooldown": float}
        got = {k: kinds.get(k, str)(env[v]) for k, v in names.items() if env.get(v)}
        if env.get("SHARD_URLS"):
            got["shards"] = tuple(s.strip() for s in env["SHARD_URLS"].split(",") if s.strip())
        return cls(**got)
