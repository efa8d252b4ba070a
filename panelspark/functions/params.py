"""Driver-side checks of parameters."""

from __future__ import annotations

import math


class ParameterError(ValueError):
    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


def number_in(value, name: str, low: float, high: float) -> float:
    try:
        out = float(value)
    except (TypeError, ValueError):
        raise ParameterError("not-a-number", f"{name} is {value!r}") from None
    if not math.isfinite(out) or not low <= out <= high:
        raise ParameterError("out-of-range", f"{name} must lie in {low}..{high}")
    return round(out, 6)


def integer_in(value, name: str, low: int, high: int) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or not low <= value <= high:
        raise ParameterError("out-of-range", f"{name} must be an integer in {low}..{high}")
    return value


def size_list(value: str, most: int = 32) -> list[int]:
    """Comma-separated sizes of 1 to 512, without repeats, in their order."""
    parts = [p.strip() for p in str(value).split(",")]
    if not all(p.isdigit() and 1 <= int(p) <= 512 for p in parts):
        raise ParameterError("sizes-invalid", value)
    out = list(dict.fromkeys(map(int, parts)))
    if len(out) > most:
        raise ParameterError("sizes-invalid", f"more than {most}")
    return out


def name_list(value: str) -> list[str]:
    return [p.strip() for p in str(value).split(",") if p.strip()]


def known_only(given: dict, allowed: set[str]) -> dict:
    if extra := sorted(given.keys() - allowed):
        raise ParameterError("unknown-parameter", ", ".join(extra))
    return given


def correction_of(dx, dy, proposed: tuple[float, float] | None) -> tuple[float, float]:
    """Given values, or the proposal's where none is given; both axes have to be settled."""
    base = proposed or (None, None)
    out = tuple(b if v is None else number_in(v, n, -100, 100) for v, b, n in ((dx, base[0], "dx"), (dy, base[1], "dy")))
    if None in out:
        raise ParameterError("correction-missing", "no value and no proposal")
    return out
