"""Settings files, path filters, and which errors are worth another try."""

from __future__ import annotations

import os
import math
import time
from collections.abc import Callable
from typing import TypeVar

#: Paths that the tracker leaves out, and what transient errors say.
UNTRACKED = (".mcp_data/", ".git/", "node_modules/", "build/", "dist/", "landing/.next/")
TRANSIENT = ("throttlingexception", "toomanyrequestsexception", "serviceunavailableexception", "internalserverexception", "modeltimeoutexception", "timeout", "connection reset")
RETRIED_CODES = (429, 502, 503)
Result = TypeVar("Result")


def load_dotenv(text: str, environment: dict[str, str] | None = None) -> dict[str, str]:
    """Names and values of a settings file: # lines are comments, the first = splits, one pair of quotes
    goes; what the environment has already wins."""
    real = os.environ if environment is None else environment
    out: dict[str, str] = {}
    for line in text.splitlines():
        name, found, value = line.strip().partition("=")
        if not found or name.startswith("#"):
            continue
        value = value.strip()
        if len(value) >= 2 and value[0] == value[-1] and value[0] in "'\"":
            value = value[1:-1]
        out[name.strip()] = real.get(name.strip(), value)
    return out


def should_track(path: str) -> bool:
    plain = path.replace("\\", "/").lstrip("/")
    return bool(path) and not plain.startswith(UNTRACKED)


def clamped(files_per_tick: int = 8, debounce_ms: int = 700) -> tuple[int, int]:
    return max(5, min(10, files_per_tick)), max(100, debounce_ms)


def is_transient(error: object) -> bool:
    return getattr(error, "status", None) in RETRIED_CODES or any(x in str(error).lower() for x in TRANSIENT)


def is_context_length(error: object) -> bool:
    text = str(error).lower()
    return "input length exceeds context length" in text or ("context" in text and "exceed" in text)


def threshold(value: float | None, fallback: float) -> float:
    """A share: above 1 it is a percentage, below 0 it is 0, and without a number the fallback."""
    if value is None or not math.isfinite(value):
        return fallback
    return min(1.0, max(0.0, value / 100 if value > 1 else value))


def weight(value: float | None, fallback: float) -> float:
    """A finite number of 0 or more, else the fallback."""
    return fallback if value is None or not math.isfinite(value) or value < 0 else value


def top_k(value: float | None, fallback: int) -> int:
    """A whole number of 1 or more, rounded down; without a finite number the fallback."""
    return fallback if value is None or not math.isfinite(value) else max(1, math.floor(value))


def search_options(top: float | None = None, **given: object) -> dict:
    """Arguments of search.hybrid_search from what a caller gives, shares or percentages, with defaults."""
    number = given.get
    return {
        "k": top_k(top, 5),
        "semantic_weight": weight(number("semantic_weight"), 0.72),
        "keyword_weight": weight(number("keyword_weight"), 0.28),
        "least_semantic": threshold(number("least_semantic"), 0.0),
        "least_keyword": threshold(number("least_keyword"), 0.0),
        "least": threshold(number("least"), 0.1),
        "require_keyword": bool(number("require_keyword")),
        "require_semantic": bool(number("require_semantic")),
    }


def retried(call: Callable[[], Result], attempts: int = 3, pause_s: float = 2.0) -> Result:
    """Calls up to ``attempts`` times, with a longer pause after each transient error."""
    for attempt in range(1, attempts + 1):
        try:
            return call()
        except Exception as error:
            if attempt == attempts or not is_transient(error):
                raise
            time.sleep(pause_s * attempt)
    raise AssertionError
