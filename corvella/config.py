"""Settings with their defaults; an empty string in the environment counts as unset."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    chunk_size: int = 800
    overlap_size: int = 200
    rows_per_document: int = 50
    table_batch_rows: int = 25
    table_batch_chars: int = 650
    overlap_share: float = 0.60
    scanned_chars: int = 50
    scanned_image_share: float = 0.50
    image_least_share: float = 0.01
    images_per_page: int = 8
    full_width_share: float = 0.65
    embed_batch: int = 96
    index_threshold: int = 1000
    input_characters: int = 1024
    search_limit: int = 5
    search_most: int = 10
    query_characters: int = 500
    file_bytes: int = 10 * 1024 * 1024
    task_seconds: int = 600
    task_grace_seconds: int = 60
    retention_seconds: int = 86_400
    vision_retries: int = 3
    answer_tokens: int = 1000
    temperature: float = 0.1
    vector_backend: str = "pgvector"
    distance: str = "cosine"
    language: str = "en"

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None, prefix: str = "CORVELLA_") -> Settings:
        env = os.environ if env is None else env
        given = {}
        for f in fields(cls):
            raw = env.get(prefix + f.name.upper(), "")
            if raw != "":
                given[f.name] = type(f.default)(raw)
        return cls(**given)
