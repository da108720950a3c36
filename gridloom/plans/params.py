"""Parameter strings (-key=value), sweeps over ranges, and their products."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from itertools import product


def value(text: str):
    """bool, int, float, a triple of numbers, or the string."""
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    parts = text.split(",")
    if len(parts) == 3 and all(re.fullmatch(r"\s*-?\d+(\.\d*)?([eE]-?\d+)?\s*", p) for p in parts):
        return tuple(float(p) if re.search(r"[.eE]", p) else int(p) for p in parts)
    return text


def parse(text: str) -> dict:
    """Options of a string; a bare -flag is true; quotes keep spaces."""
    out = {}
    for m in re.finditer(r"""-([A-Za-z_]\w*)(?:=("[^"]*"|'[^']*'|\S+))?""", text):
        out[m[1].lower()] = True if m[2] is None else value(m[2].strip("\"'"))
    return out


def render(options: dict) -> str:
    return " ".join(f"-{k}={','.join(map(str, v)) if isinstance(v, tuple) else str(v).lower() if isinstance(v, bool) else v}" for k, v in options.items())


def linear(low: float, high: float, steps: int) -> list[float]:
    """steps values from low, without high."""
    return [i * (high - low) / steps + low for i in range(steps)]


def linear_inclusive(low: float, high: float, steps: int, whole: bool = False) -> list[float]:
    """steps values from low to high; whole ones once each."""
    values = [low + i * (high - low) / max(1, steps - 1) for i in range(steps)]
    return list(dict.fromkeys(int(round(v)) for v in values)) if whole else values


def logarithmic(low: float, high: float, steps: int) -> list[float]:
    return [low * (high / low) ** (i / max(1, steps - 1)) for i in range(steps)]


def sweep(ranges: dict[str, Iterable]) -> list[dict]:
    """The product of all parameters' values."""
    return [dict(zip(ranges, v, strict=True)) for v in product(*ranges.values())]


def run_sweep(spark_df, ranges: dict[str, Iterable], run: Callable):
    """Union of run(df, **parameters) over the product, with the parameters as columns; lazy, so Spark shares scans."""
    from pyspark.sql import functions as F

    out = None
    for options in sweep(ranges):
        part = run(spark_df, **options)
        part = part.select(*[F.lit(v).alias(k) for k, v in options.items()], *part.columns)
        out = part if out is None else out.unionByName(part)
    return out
