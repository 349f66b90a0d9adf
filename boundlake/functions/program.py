"""Calculation programs: an immutable expression DAG, its JSON form and hashes.

Node kinds: const, var, op, call, hole (an opaque part with a physical range)
and disj (a set of candidates). Programs compile to one projection for each
slot, so cost stays linear in their size and Catalyst sees plain expressions.
"""

from __future__ import annotations

import hashlib
import json
import math
import struct
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import interval as iv

OPS = {"add": 2, "sub": 2, "mul": 2, "div": 2, "neg": 1, "pow": 2, "sqrt": 1, "log": 1, "exp": 1, "sin": 1, "cos": 1, "tan": 1}
ENTIRE = (-math.inf, math.inf)


@dataclass(frozen=True)
class Node:
    kind: str
    value: float = 0.0
    name: str = ""  # operator, function, symbol or hole id
    phys: tuple[float, float] = ENTIRE
    regime: str = "A"
    args: tuple[Node, ...] = field(default=())

    @cached_property
    def hash(self) -> bytes:
        """SHA-256 over the node's own fields and its children's hashes."""
        own = self.kind.encode() + b"\0" + struct.pack("<d", self.value) + self.name.encode() + b"\0" + struct.pack("<2d", *self.phys) + self.regime.encode() + b"\0"
        return hashlib.sha256(own + b"".join(x.hash for x in self.args)).digest()


def const(v: float) -> Node:
    return Node("const", float(v))


def var(name: str, phys: tuple[float, float] = ENTIRE) -> Node:
    return Node("var", name=name, phys=phys)


def op(name: str, *args: Node) -> Node:
    if OPS.get(name) != len(args):
        raise ValueError(f"{name} takes {OPS.get(name)} arguments")
    return Node("op", name=name, args=args)


def call(name: str, *args: Node) -> Node:
    return Node("call", name=name, args=args)


def hole(name: str, phys: tuple[float, float], regime: str = "B", *args: Node) -> Node:
    return Node("hole", name=name, phys=phys, regime=regime, args=args)


def disj(*args: Node) -> Node:
    return Node("disj", args=args)


def to_json(node: Node) -> dict:
    if node.kind == "const":
        return {"kind": "const", "v": node.value}
    if node.kind == "var":
        return {"kind": "var", "sym": node.name} | ({"phys": list(node.phys)} if node.phys != ENTIRE else {})
    kids = [to_json(x) for x in node.args]
    if node.kind == "op":
        return {"kind": "op", "op": node.name, "args": kids}
    if node.kind == "call":
        return {"kind": "call", "fn": node.name, "args": kids}
    if node.kind == "hole":
        return {"kind": "hole", "id": node.name, "arity": len(kids), "regime": node.regime, "phys": list(node.phys), "args": kids}
    return {"kind": "disj", "cands": kids}


def from_json(data: dict) -> Node:
    """Unknown kinds become the constant 0; missing fields take defaults."""
    kind = data.get("kind")
    kids = tuple(from_json(x) for x in data.get("args", data.get("cands", [])))
    phys = tuple(map(float, data["phys"])) if isinstance(data.get("phys"), list) and len(data["phys"]) == 2 else ENTIRE
    if kind == "const":
        return const(float(data.get("v", 0.0)))
    if kind == "var":
        return var(str(data.get("sym", "")), phys)
    if kind == "op":
        return op(str(data.get("op", "")), *kids)
    if kind == "call":
        return call(str(data.get("fn", "")), *kids)
    if kind == "hole":
        return hole(str(data.get("id", "")), phys, str(data.get("regime", "B")), *kids)
    if kind == "disj":
        return disj(*kids)
    return const(0.0)


def load(text: str) -> tuple[Node, dict[str, tuple[float, float]], float]:
    """Root, box and model uncertainty of a program file."""
    data = json.loads(text)
    box = {k: (float(v[0]), float(v[1])) for k, v in data.get("box", {}).items()}
    return from_json(data["ast"]), box, float(data.get("ks", 0.0))


@dataclass(frozen=True)
class Slot:
    node: Node
    args: tuple[int, ...]


def linearize(root: Node) -> list[Slot]:
    """Slots in evaluation order, one for each different subexpression."""
    slots: list[Slot] = []
    place: dict[bytes, int] = {}
    stack: list[tuple[Node, bool]] = [(root, False)]
    while stack:
        node, ready = stack.pop()
        if node.hash in place:
            continue
        if ready:
            place[node.hash] = len(slots)
            slots.append(Slot(node, tuple(place[x.hash] for x in node.args)))
        else:
            stack.append((node, True))
            stack += [(x, False) for x in reversed(node.args) if x.hash not in place]
    return slots


def uses(slots: list[Slot]) -> list[int]:
    """How often each slot occurs in the tree that the DAG stands for."""
    count = [0] * len(slots)
    count[-1] = 1
    for i in range(len(slots) - 1, -1, -1):
        for a in slots[i].args:
            count[a] += count[i]
    return count


def rows(program_id: str, root: Node) -> list[tuple]:
    """The program as rows (program, slot, kind, name, value, phys_lo, phys_hi, regime, args, hash)."""
    return [(program_id, i, s.node.kind, s.node.name, s.node.value, *s.node.phys, s.node.regime, list(s.args), s.node.hash.hex()) for i, s in enumerate(linearize(root))]


ROW_SCHEMA = "program string, slot int, kind string, name string, value double, phys_lo double, phys_hi double, regime string, args array<int>, hash string"

_UNARY = {"neg": iv.neg, "sqrt": iv.sqrt, "log": iv.log, "exp": iv.exp, "sin": iv.sin, "cos": iv.cos, "tan": iv.tan}
_BINARY = {"add": iv.add, "sub": iv.sub, "mul": iv.mul, "div": iv.div}
_PLAIN = (iv.neg, iv.add, iv.sub)
_EXACT = {"add": iv.exact_add, "sub": iv.exact_sub, "mul": iv.exact_mul}


def _slot_bounds(slot: Slot, at: list[iv.Ival], slots: list[Slot], exact: bool, columns: dict[str, iv.Ival], steps: iv.Steps) -> iv.Ival:
    node, args = slot.node, [at[i] for i in slot.args]
    if node.kind == "const":
        return iv.Ival.point(node.value)
    if node.kind == "var":
        own = iv.Ival(iv.number(node.phys[0]), iv.number(node.phys[1]))
        given = columns.get(node.name)
        return own if given is None else iv.Ival(f"coalesce({given.lo}, {own.lo})", f"coalesce({given.hi}, {own.hi})")
    if node.kind == "hole":
        given = columns.get(node.name)
        own = iv.Ival(iv.number(node.phys[0]), iv.number(node.phys[1]))
        if given is None:
            return own
        model = f"{given.lo} <= {given.hi}"  # a missing or empty (refuted) model falls back to the physical range
        return iv.Ival(f"(CASE WHEN {model} THEN {given.lo} ELSE {own.lo} END)", f"(CASE WHEN {model} THEN {given.hi} ELSE {own.hi} END)")
    if node.kind == "disj":
        out = args[0]
        for x in args[1:]:
            out = iv.hull(out, x)
        return out
    if node.kind == "call":
        name = node.name.lower()
        if name in ("max", "min") and len(args) == 2:
            return (iv.maximum if name == "max" else iv.minimum)(*args)
        if name == "abs" and len(args) == 1:
            return iv.absolute(args[0])
        return iv.ENTIRE  # an unknown function bounds nothing
    if node.name == "pow":
        exponent = slots[slot.args[1]].node
        return iv.rpow(args[0], exponent.value, steps) if exponent.kind == "const" else iv.pow_interval(*args, steps)
    made = {**_UNARY, **_BINARY, **(_EXACT if exact else {})}[node.name]
    return made(*args) if made in _PLAIN else made(*args, steps)


def stages(root: Node, columns: dict[str, tuple[str, str]], ks: float = 0.0, exact: bool = False) -> list[list[tuple[str, str]]]:
    """Projections to apply in order: lists of (column, SQL text).

    ``columns`` names the bounds of variables and hole models. The last stage
    gives ``ms_lo``, ``ms_hi`` and ``residual``: half the width of every hole's
    range, counted once for each occurrence, plus ``ks``.
    """
    slots = linearize(root)
    bounds = {k: iv.Ival(*v) for k, v in columns.items()}
    at: list[iv.Ival] = []
    out: list[list[tuple[str, str]]] = []
    for i, slot in enumerate(slots):
        steps = iv.Steps(f"s{i}")
        made = _slot_bounds(slot, at, slots, exact, bounds, steps)
        if slot.node.kind == "const":
            at.append(made)
            continue
        names = (f"s{i}_lo", f"s{i}_hi")
        out += steps.stages
        out.append([(names[0], made.lo), (names[1], made.hi)])
        at.append(iv.Ival(*names))
    terms = [iv.number(ks)]
    for i, (slot, n) in enumerate(zip(slots, uses(slots))):
        if slot.node.kind == "hole":
            terms.append(f"{n} * (({at[i].hi} - {at[i].lo}) / 2)")
    out.append([("ms_lo", at[-1].lo), ("ms_hi", at[-1].hi), ("residual", " + ".join(terms))])
    return out


def evaluate(df: DataFrame, root: Node, columns: dict[str, tuple[str, str]], ks: float = 0.0, exact: bool = False) -> DataFrame:
    """All columns of ``df`` with ``ms_lo``, ``ms_hi`` and ``residual`` of the program on each row."""
    keep = df.columns
    for stage in stages(root, columns, ks, exact):
        df = df.select("*", *(F.expr(sql).alias(name) for name, sql in stage))
    return df.select(*keep, "ms_lo", "ms_hi", "residual")


def to_sql(root: Node, columns: dict[str, tuple[str, str]], source: str, keep: list[str], ks: float = 0.0) -> str:
    """The same as nested SELECTs over ``source``, for any SQL engine."""
    text = source
    for k, stage in enumerate(stages(root, columns, ks)):
        text = f"(SELECT *, {', '.join(f'{sql} AS {name}' for name, sql in stage)} FROM {text} AS t{k})"
    return f"SELECT {', '.join([*keep, 'ms_lo', 'ms_hi', 'residual'])} FROM {text} AS whole"


def differences(old: Node, new: Node) -> dict[str, list[str]]:
    """Hashes that changed or stayed, and holes that opened or closed."""
    a, b = {s.node.hash.hex() for s in linearize(old)}, {s.node.hash.hex() for s in linearize(new)}
    ha, hb = ({s.node.name for s in linearize(x) if s.node.kind == "hole"} for x in (old, new))
    return {"changed": sorted(b - a), "unchanged": sorted(a & b), "new_holes": sorted(hb - ha), "closed_holes": sorted(ha - hb)}


def node_differences(old: DataFrame, new: DataFrame) -> DataFrame:
    """The same for tables of program rows: (program, hash, change) by set operations."""
    a, b = old.select("program", "hash"), new.select("program", "hash")
    return (
        b.subtract(a).withColumn("change", F.lit("changed"))
        .unionByName(b.intersect(a).withColumn("change", F.lit("unchanged")))
        .unionByName(a.subtract(b).withColumn("change", F.lit("dropped")))
    )
