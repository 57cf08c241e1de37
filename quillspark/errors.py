"""Typed errors, input checks and retries."""

from __future__ import annotations

import math
import time
from collections.abc import Callable


class EngineError(Exception):
    """An error with a stable code and details."""

    def __init__(self, message: str, code: str = "ENGINE_ERROR", **details):
        super().__init__(message)
        self.code, self.details = code, details


class DimensionMismatch(EngineError):
    def __init__(self, expected: int, actual: int):
        super().__init__(f"vectors of dimension {expected} expected, {actual} found", "DIMENSION_MISMATCH", expected=expected, actual=actual)


class InvalidVector(EngineError):
    def __init__(self, message: str, **details):
        super().__init__(message, "INVALID_VECTOR", **details)


class InvalidParams(EngineError):
    def __init__(self, message: str, **details):
        super().__init__(message, "INVALID_PARAMS", **details)


class ImportFailed(EngineError):
    def __init__(self, message: str, **details):
        super().__init__(message, "IMPORT_ERROR", **details)


MAX_K = 10_000


def check_k(k: int) -> int:
    """k, if it is a whole number from 1 to MAX_K."""
    if isinstance(k, bool) or not isinstance(k, int) or not 1 <= k <= MAX_K:
        raise InvalidParams(f"k must be a whole number from 1 to {MAX_K}, not {k!r}", k=k)
    return k


def check_vector(vector, dimensions: int) -> list[float]:
    """The vector as floats, if it has that many and all are finite."""
    if vector is None or isinstance(vector, (str, bytes)):
        raise InvalidVector("a vector must be a sequence of numbers")
    out = [float(x) for x in vector]
    if len(out) != dimensions:
        raise DimensionMismatch(dimensions, len(out))
    bad = next((i for i, x in enumerate(out) if not math.isfinite(x)), None)
    if bad is not None:
        raise InvalidVector(f"component {bad} is {out[bad]}", index=bad)
    return out


#: Characters that stored strings hold as entities. The ampersand isn't among them.
ESCAPES = (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"), ("/", "&#x2F;"))


def escape(value: str) -> str:
    for raw, entity in ESCAPES:
        value = value.replace(raw, entity)
    return value


def sanitise(metadata):
    """Metadata with every string escaped, at any depth; functions and the like are refused."""
    if isinstance(metadata, str):
        return escape(metadata)
    if metadata is None or isinstance(metadata, (bool, int, float)):
        return metadata
    if isinstance(metadata, (list, tuple)):
        return [sanitise(x) for x in metadata]
    if isinstance(metadata, dict):
        return {str(k): sanitise(v) for k, v in metadata.items()}
    raise InvalidParams(f"metadata can't hold a {type(metadata).__name__}")


def with_retry(action: Callable, attempts: int = 3, first_wait: float = 0.1, factor: float = 2.0, longest_wait: float = 5.0, sleep: Callable = time.sleep):
    """action(), again after a growing wait while it fails; the last failure is raised."""
    wait = first_wait
    for turn in range(1, attempts + 1):
        try:
            return action()
        except Exception:
            if turn == attempts:
                raise
            sleep(wait)
            wait = min(wait * factor, longest_wait)
