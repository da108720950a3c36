"""Offset tables of structuring kernels: bounded by the window, known on the driver, sent as literals."""

from __future__ import annotations

from itertools import product
from math import sqrt

Offset = tuple[int, int, int]


def full(n: int = 1) -> list[Offset]:
    return list(product(range(-n, n + 1), repeat=3))


def cross(n: int = 1) -> list[Offset]:
    """At most one axis differs from zero: faces at n = 1, an axis cross beyond."""
    return [d for d in full(n) if sum(c != 0 for c in d) <= 1]


def sphere(rx: float, ry: float | None = None, rz: float | None = None) -> list[Offset]:
    radii = (rx, rx if ry is None else ry, rx if rz is None else rz)
    spans = [range(-int(r), int(r) + 1) for r in radii]
    return [d for d in product(*spans) if sqrt(sum((c / r) ** 2 if r else float(c != 0) * 2 for c, r in zip(d, radii, strict=True))) <= 1]


def kernel(kind: str | int = "full", n: int = 1, radius: float = 1.0) -> list[Offset]:
    kind = {0: "full", 1: "cross", 2: "sphere"}.get(kind, kind)
    return {"full": lambda: full(n), "cross": lambda: cross(n), "sphere": lambda: sphere(radius)}[kind]()


def forward(offsets: list[Offset]) -> list[Offset]:
    """One of each pair of opposite offsets, without the centre."""
    return [d for d in offsets if d > (0, 0, 0)]
