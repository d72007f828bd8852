"""Settings from the environment."""

from __future__ import annotations

import logging
import os
from dataclasses import dataclass


def csv_env(name: str, default: str = "") -> tuple[str, ...]:
    return tuple(x.strip() for x in os.environ.get(name, default).split(",") if x.strip())


@dataclass(frozen=True)
class EngineConfig:
    data_dir: str
    communities: tuple[str, ...]
    post_limit: int
    comment_limit: int
    log_level: str

    @classmethod
    def from_env(cls) -> EngineConfig:
        get = os.environ.get
        return cls(get("TURNSTILE_DATA_DIR", "data"), csv_env("TURNSTILE_COMMUNITIES", "soccer,football"), int(get("TURNSTILE_POST_LIMIT", "50")), int(get("TURNSTILE_COMMENT_LIMIT", "100")), get("TURNSTILE_LOG_LEVEL", "INFO"))


def get_logger(name: str, level: str | None = None) -> logging.Logger:
    logger = logging.getLogger(name)
    logger.setLevel(level or EngineConfig.from_env().log_level)
    return logger
