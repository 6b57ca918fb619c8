"""Scalar helpers for settings and parameters; they run on the driver."""

from __future__ import annotations

from collections.abc import Sequence

#: Texts that stand for no value or for a default, in any case.
NONE_TEXTS = ("none", "null", "nan", "")
DEFAULT_TEXTS = ("default", "auto", "normal")
TRUE_TEXTS = ("true", "1", "t", "y", "yes", "yeah", "yup")


def is_empty(text) -> bool:
    return str(text) == ""


def is_none(text) -> bool:
    return str(text).lower() in NONE_TEXTS


def is_default(text) -> bool:
    return str(text).lower() in DEFAULT_TEXTS


def is_default_or_none(text) -> bool:
    return is_default(text) or is_none(text)


def is_true(text) -> bool:
    return str(text).lower() in TRUE_TEXTS


def is_number(text) -> bool:
    try:
        float(text)
    except (TypeError, ValueError):
        return False
    return True


def to_length(values, n: int) -> list:
    """A scalar or single value repeated n times; n values as they are. Other lengths raise."""
    values = list(values) if isinstance(values, Sequence) and not isinstance(values, str) else [values]
    if len(values) == 1:
        return values * n
    if len(values) != n:
        raise ValueError(f"{len(values)} values where 1 or {n} are asked for")
    return values


def zip_parameters(**lists) -> list[dict]:
    """Parameter tuples from scalars and lists; scalars and single values go with all."""
    n = max(len(v) if isinstance(v, (list, tuple)) else 1 for v in lists.values())
    wide = {k: to_length(v, n) for k, v in lists.items()}
    return [{k: v[i] for k, v in wide.items()} for i in range(n)]


def interpolate_colours(stops: Sequence[float], levels: Sequence[float], x: float) -> float:
    """Piecewise linear: where x lies among levels, carried over to stops."""
    if x <= levels[0]:
        return stops[0]
    for (a, b), (s, t) in zip(zip(levels, levels[1:], strict=False), zip(stops, stops[1:], strict=False), strict=True):
        if x <= b:
            return s + (t - s) * (x - a) / (b - a) if b > a else t
    return stops[-1]
