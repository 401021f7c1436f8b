"""Join specifications: what has to hold between a left and a right row."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

_FLIPPED = {"==": "==", ">": "<", "<": ">", ">=": "<=", "<=": ">="}
_BOUNDS = {"[]": (">=", "<="), "[)": (">=", "<"), "(]": (">", "<="), "()": (">", "<")}
_NAME = r"(?:([xy])\$)?(`[^`]+`|[\w.]+)"


@dataclass(frozen=True)
class Condition:
    """left column, operator, right column; closest keeps the nearest right values only."""

    x: str
    op: str
    y: str
    closest: bool = False


@dataclass(frozen=True)
class JoinSpec:
    conditions: tuple[Condition, ...]
    cross: bool = False

    @property
    def equal(self) -> list[Condition]:
        return [c for c in self.conditions if c.op == "=="]

    @property
    def only_equal(self) -> bool:
        return all(c.op == "==" for c in self.conditions)


def _side(text: str, side: str) -> tuple[str, str]:
    m = re.fullmatch(_NAME, text.strip())
    if not m:
        raise ValueError(f"{text!r} is no column of a join")
    return m[1] or side, m[2].strip("`")


def _comparison(text: str) -> Condition:
    m = re.fullmatch(rf"\s*({_NAME})\s*(==|>=|<=|>|<)\s*({_NAME})\s*", text)
    if not m:
        raise ValueError(f"{text!r} is no comparison of a left with a right column")
    (a, left), op, (b, right) = _side(m[1], "x"), m[4], _side(m[5], "y")
    if m[2] and not m[6]:
        b = "y" if a == "x" else "x"
    if m[6] and not m[2]:
        a = "y" if b == "x" else "x"
    if a == b:
        raise ValueError(f"{text!r} names one table twice")
    return Condition(left, op, right) if a == "x" else Condition(right, _FLIPPED[op], left)


def _arguments(text: str) -> tuple[list[str], dict[str, str]]:
    parts = [p.strip() for p in text.split(",")]
    named = dict(re.split(r"\s*=\s*", p, maxsplit=1) for p in parts if re.match(r"bounds\s*=", p))
    return [p for p in parts if not re.match(r"bounds\s*=", p)], {k: v.strip("\"'") for k, v in named.items()}


def _parse(text: str) -> list[Condition]:
    m = re.fullmatch(r"\s*(closest|between|within|overlaps)\((.*)\)\s*", text, re.S)
    if not m:
        if re.fullmatch(rf"\s*{_NAME}\s*", text):
            name = _side(text, "x")[1]
            return [Condition(name, "==", name)]
        return [_comparison(text)]
    kind, inner = m[1], m[2]
    if kind == "closest":
        c = _comparison(inner)
        if c.op == "==":
            raise ValueError("closest() takes an inequality")
        return [Condition(c.x, c.op, c.y, True)]
    given, named = _arguments(inner)
    bounds = named.get("bounds", "[]")
    if bounds not in _BOUNDS:
        raise ValueError(f"no such bounds: {bounds}")
    if kind == "between":
        if len(given) != 3:
            raise ValueError("between() takes a column and two limits")
        low, high = _BOUNDS[bounds]
        (a, v), (_, lo), (_, hi) = _side(given[0], "x"), _side(given[1], "y"), _side(given[2], "y")
        if a == "y":
            return [Condition(lo, _FLIPPED[low], v), Condition(hi, _FLIPPED[high], v)]
        return [Condition(v, low, lo), Condition(v, high, hi)]
    if len(given) != 4:
        raise ValueError(f"{kind}() takes the ends of two ranges")
    sides = [_side(g, "x" if k < 2 else "y") for k, g in enumerate(given)]
    names = [n for _, n in sides]
    if sides[0][0] == "y":
        if kind == "within":
            return [Condition(names[2], "<=", names[0]), Condition(names[3], ">=", names[1])]
        names = names[2:] + names[:2]
    if kind == "within":
        return [Condition(names[0], ">=", names[2]), Condition(names[1], "<=", names[3])]
    low, high = ("<=", ">=") if bounds == "[]" else ("<", ">")
    return [Condition(names[0], low, names[3]), Condition(names[1], high, names[2])]


def join_by(*conditions: Any) -> JoinSpec:
    """A specification from texts such as "id", "a == b", "x >= y", "closest(t >= ts)",
    "between(v, lo, hi)", "within(a, b, c, d)" and "overlaps(a, b, c, d, bounds = '[)')".

    The left side of a comparison is of the left table unless x$ or y$ says
    otherwise.
    """
    if not conditions:
        raise ValueError("join_by() takes at least one condition; cross_join() takes none")
    return JoinSpec(tuple(c for text in conditions for c in (_parse(text) if isinstance(text, str) else [text])))


def as_join_spec(by: Any, x: list[str], y: list[str]) -> JoinSpec:
    """A specification from join_by(), names, a dict of left to right names, or all common names."""
    if isinstance(by, JoinSpec):
        return by
    if by is None:
        common = [c for c in x if c in set(y)]
        if not common:
            raise ValueError("the tables have no columns in common")
        by = common
    if isinstance(by, str):
        by = [by]
    pairs = list(by.items()) if isinstance(by, dict) else [(b, b) if isinstance(b, str) else tuple(b) for b in by]
    return JoinSpec(tuple(Condition(a, "==", b) for a, b in pairs), cross=not pairs)
