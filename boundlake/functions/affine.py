"""Affine forms: enclosures that keep the correlation of shared inputs.

A form is centre + sum(coefficient * noise) + error, one noise symbol for each
input of the row, so that x - x is 0. Rounding of every operation goes into the
error term. ``evaluate`` runs a program over many boxes at once in numpy.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .program import Node, linearize

U = 2.0**-52


@dataclass
class Affine:
    centre: np.ndarray
    terms: dict[str, np.ndarray]
    error: np.ndarray

    @staticmethod
    def symbol(name: str, lo: np.ndarray, hi: np.ndarray) -> Affine:
        centre, radius = lo / 2 + hi / 2, (hi - lo) / 2
        slack = U * (np.abs(centre) + np.abs(radius)) * 2
        return Affine(centre, {name: radius}, slack)

    @staticmethod
    def interval(lo: np.ndarray, hi: np.ndarray) -> Affine:
        centre, radius = lo / 2 + hi / 2, (hi - lo) / 2
        return Affine(centre, {}, radius + U * (np.abs(centre) + np.abs(radius)) * 2)

    def radius(self) -> np.ndarray:
        return sum((np.abs(t) for t in self.terms.values()), self.error)

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        r = self.radius() * (1 + 4 * U)
        return self.centre - r - U * np.abs(self.centre), self.centre + r + U * np.abs(self.centre)

    def _linear(self, a: float | np.ndarray, other: Affine | None, b: float | np.ndarray, constant: float | np.ndarray = 0.0) -> Affine:
        terms = {k: a * t for k, t in self.terms.items()}
        centre, error = a * self.centre + constant, np.abs(a) * self.error
        if other is not None:
            centre = centre + b * other.centre
            error = error + np.abs(b) * other.error
            for k, t in other.terms.items():
                terms[k] = terms.get(k, 0.0) + b * t
        size = np.abs(centre) + sum((np.abs(t) for t in terms.values()), np.abs(constant) + error)
        return Affine(centre, terms, error + 4 * U * (len(terms) + 2) * size)

    def __add__(self, other: Affine) -> Affine:
        return self._linear(1.0, other, 1.0)

    def __sub__(self, other: Affine) -> Affine:
        return self._linear(1.0, other, -1.0)

    def __neg__(self) -> Affine:
        return Affine(-self.centre, {k: -t for k, t in self.terms.items()}, self.error)

    def scale(self, k: float) -> Affine:
        return self._linear(k, None, 0.0)

    def __mul__(self, other: Affine) -> Affine:
        out = self._linear(other.centre, other, self.centre, -self.centre * other.centre)
        return Affine(out.centre, out.terms, out.error + self.radius() * other.radius() * (1 + 8 * U))

    def inverse(self) -> Affine:
        lo, hi = self.bounds()
        zero = (lo <= 0) & (hi >= 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            a, b = np.where(zero, -np.inf, 1 / hi), np.where(zero, np.inf, 1 / lo)
        return Affine.interval(np.where(zero, -np.inf, np.minimum(a, b)), np.where(zero, np.inf, np.maximum(a, b)))

    def __truediv__(self, other: Affine) -> Affine:
        return self * other.inverse()


def evaluate(root: Node, boxes: dict[str, tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of a program on many boxes; functions without an affine rule go through intervals."""
    n = len(next(iter(boxes.values()))[0])
    full = lambda v: np.full(n, float(v))
    at: list[Affine] = []
    with np.errstate(all="ignore"):
        for slot in linearize(root):
            node, args = slot.node, [at[i] for i in slot.args]
            if node.kind == "const":
                out = Affine(full(node.value), {}, full(0))
            elif node.kind == "var" and node.name in boxes:
                out = Affine.symbol(node.name, *boxes[node.name])
            elif node.kind in ("var", "hole"):
                out = Affine.interval(full(node.phys[0]), full(node.phys[1]))
            elif node.kind == "disj":
                ends = [x.bounds() for x in args]
                out = Affine.interval(np.min([e[0] for e in ends], axis=0), np.max([e[1] for e in ends], axis=0))
            elif node.kind == "op" and node.name in ("add", "sub", "mul", "div"):
                a, b = args
                out = {"add": a.__add__, "sub": a.__sub__, "mul": a.__mul__, "div": a.__truediv__}[node.name](b)
            elif node.kind == "op" and node.name == "neg":
                out = -args[0]
            elif node.kind == "op" and node.name in ("exp", "log", "sqrt"):
                lo, hi = args[0].bounds()
                fn = {"exp": np.exp, "log": np.log, "sqrt": np.sqrt}[node.name]
                lo = np.maximum(lo, 0) if node.name != "exp" else lo
                a, b = fn(lo), fn(hi)
                out = Affine.interval(a - 4 * U * np.abs(a), b + 4 * U * np.abs(b))
            else:
                out = Affine.interval(full(-np.inf), full(np.inf))
            at.append(out)
        lo, hi = at[-1].bounds()
    return np.where(np.isnan(lo), -np.inf, lo), np.where(np.isnan(hi), np.inf, hi)
