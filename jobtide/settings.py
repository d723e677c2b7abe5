"""Engine settings: a TOML file under the environment's overrides, merged and checked on the driver."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any

QUEUE_PREFIX, DLQ_PREFIX = "queue:", "dlq:"
IDEMPOTENCY_PREFIX, RATE_PREFIX, DEBOUNCE_PREFIX = "idempotency:", "rate_limit:", "debounce:"
ENV_FILE, ENV_PREFIX = "JOBTIDE_CONFIG", "JOBTIDE_"
LOCAL_FILE = "jobtide.toml"


@dataclass(frozen=True)
class Settings:
    # The defaults that results depend on.
    default_queue_name: str = "queue:default"
    default_dlq_name: str = "dlq:default"
    default_max_retries: int = 5
    default_job_timeout_seconds: int = 300
    default_lock_timeout_extension_seconds: int = 60
    default_result_ttl_seconds: int = 86_400
    default_poll_delay_seconds: float = 0.1
    default_unique_job_lock_ttl_seconds: int = 21_600
    worker_concurrency: int = 1
    worker_health_check_interval_seconds: float = 60.0
    worker_health_check_ttl_buffer_seconds: float = 10.0
    base_retry_delay_seconds: float = 5.0
    max_retry_delay_seconds: float = 3_600.0
    dlq_ttl_seconds: int = 7 * 86_400
    orphan_recovery_limit: int = 100
    default_runner_name: str = "python"
    runner_routes: dict[str, str] = field(default_factory=dict)
    correlation_mappings: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for name in ("default_max_retries", "default_job_timeout_seconds", "worker_concurrency", "default_unique_job_lock_ttl_seconds"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")
        for name in ("base_retry_delay_seconds", "max_retry_delay_seconds", "default_poll_delay_seconds", "worker_health_check_ttl_buffer_seconds"):
            if not 0 <= getattr(self, name) < float("inf"):
                raise ValueError(f"{name} must be finite and not negative")
        if not 0 < self.worker_health_check_interval_seconds < float("inf"):
            raise ValueError("worker_health_check_interval_seconds must be finite and positive")
        if self.default_lock_timeout_extension_seconds < 0:
            raise ValueError("default_lock_timeout_extension_seconds must not be negative")
        for name in ("default_queue_name", "default_dlq_name", "default_runner_name"):
            if not getattr(self, name).strip():
                raise ValueError(f"{name} cannot be empty")
        for queue, runner in self.runner_routes.items():
            if not queue.removeprefix(QUEUE_PREFIX).strip() or not runner.strip():
                raise ValueError(f"route {queue!r} to {runner!r} has an empty name")


def deep_merge(base: dict[str, Any], over: dict[str, Any]) -> dict[str, Any]:
    """``over`` on ``base``; tables merge key by key, everything else is replaced."""
    return {**base, **{k: deep_merge(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}}


def config_source(path: str | None = None, env: dict[str, str] | None = None) -> Path | None:
    """An explicit path, else the one in the environment, else the file in the working folder, else none."""
    env = os.environ if env is None else env
    for p in (path, env.get(ENV_FILE)):
        if p and p.strip():
            return Path(p.strip())
    return Path(LOCAL_FILE) if Path(LOCAL_FILE).exists() else None


def env_overrides(env: dict[str, str]) -> dict[str, Any]:
    out: dict[str, Any] = {}
    for f in fields(Settings):
        v = env.get(ENV_PREFIX + f.name.upper())
        if v is not None and f.type in ("int", "float", "str"):
            out[f.name] = {"int": int, "float": float, "str": str}[f.type](v)
    return out


def load_settings(path: str | None = None, env: dict[str, str] | None = None) -> Settings:
    env = dict(os.environ) if env is None else env
    source = config_source(path, env)
    if path and source and not source.exists():
        raise FileNotFoundError(source)
    table = tomllib.loads(source.read_text()).get("jobtide", {}) if source and source.exists() else {}
    merged = deep_merge(table, env_overrides(env))
    known = {f.name for f in fields(Settings)}
    routes = {k if k.startswith(QUEUE_PREFIX) else QUEUE_PREFIX + k: v for k, v in merged.get("runner_routes", {}).items()}
    return Settings(**{k: v for k, v in merged.items() if k in known} | {"runner_routes": routes})
