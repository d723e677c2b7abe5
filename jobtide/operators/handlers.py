"""User handlers: a registry of functions, applied to requests in Arrow batches."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

RESULT = "request_id string, job_id string, status string, result string, error_type string, error_message string, retry_after_seconds double"


class RetryJob(Exception):
    """Raised by a handler that wants its job to run again, after ``defer_seconds`` if given."""

    def __init__(self, message: str = "", defer_seconds: float | None = None):
        super().__init__(message)
        self.defer_seconds = defer_seconds


class Aborted(Exception):
    """Raised by a handler whose work was called off: its outcome is an error of the type ``cancelled``, which is retried like any other."""


@dataclass
class Registry:
    handlers: dict[str, Callable[[dict[str, Any], int], Any]] = field(default_factory=dict)
    #: Called with a handler's name, attempt and status after each call, if set.
    hook: Callable[[str, int, str], None] | None = None

    def register(self, name: str, handler: Callable[[dict[str, Any], int], Any], replace: bool = False) -> None:
        if not name.strip():
            raise ValueError("a handler needs a name")
        if name in self.handlers and not replace:
            raise ValueError(f"handler {name!r} is registered already")
        self.handlers[name] = handler

    def unregister(self, name: str) -> None:
        self.handlers.pop(name, None)

    def names(self) -> list[str]:
        return sorted(self.handlers)

    def clear(self) -> None:
        self.handlers.clear()

    def run(self, name: str, params: str | None, attempt: int) -> tuple[str, str | None, str | None, str | None, float | None]:
        """(status, result, error type, error message, retry after) of one call."""
        out = self._call(name, params, attempt)
        if self.hook:
            self.hook(name, attempt, out[0])
        return out

    def _call(self, name: str, params: str | None, attempt: int) -> tuple[str, str | None, str | None, str | None, float | None]:
        handler = self.handlers.get(name)
        if handler is None:
            return "error", None, "handler_not_found", f"No handler registered for function '{name}'", None
        try:
            return "success", json.dumps(handler(json.loads(params or "{}"), attempt)), None, None, None
        except RetryJob as e:
            return "retry", None, None, str(e) or None, e.defer_seconds
        except Aborted as e:
            return "error", None, "cancelled", str(e) or "Job cancelled", None
        except TimeoutError as e:
            return "timeout", None, "timeout", str(e) or "Job execution timed out", None
        except Exception as e:  # noqa: BLE001  whatever a handler raises is its outcome
            return "error", None, type(e).__name__, str(e), None


def run_handlers(requests: DataFrame, registry: Registry) -> DataFrame:
    """Outcomes of requests (request_id, job_id, handler, params, attempt)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [registry.run(h, p, int(a)) for h, p, a in zip(b["handler"], b["params"], b["attempt"], strict=True)]
            rest = pd.DataFrame(out, columns=["status", "result", "error_type", "error_message", "retry_after_seconds"])
            yield pd.concat([b[["request_id", "job_id"]].reset_index(drop=True), rest], axis=1)

    return requests.select("request_id", "job_id", "handler", "params", "attempt").mapInPandas(run, RESULT)


def examples() -> Registry:
    """Handlers to try: quick, echo, slow (a timeout), error, abort, and retry until an attempt."""
    r = Registry()

    def error(params: dict, attempt: int) -> None:
        raise RuntimeError(params.get("message", "failed"))

    def slow(params: dict, attempt: int) -> None:
        raise TimeoutError

    def abort(params: dict, attempt: int) -> None:
        raise Aborted

    def retry(params: dict, attempt: int) -> dict:
        if attempt < params.get("until_attempt", 2):
            raise RetryJob("not yet", params.get("defer"))
        return {"attempt": attempt}

    r.register("quick", lambda params, attempt: {"ok": True})
    r.register("echo", lambda params, attempt: params)
    for name, f in (("error", error), ("slow", slow), ("abort", abort), ("retry", retry)):
        r.register(name, f)
    return r
