"""A small JSON rule language for edge weights, compiled to column expressions.

A model has statement lists ``speed``, ``priority`` and ``turn_penalty``.  A
statement has ``if``, ``else_if`` or ``else`` with a condition, and either one
of ``multiply_by``, ``limit_to`` and ``add`` with a value, or ``do`` with
nested statements.  Of a group that an ``if`` opens, only the first statement
whose condition holds acts.  Groups act from top to bottom on a start value.

Conditions know names of columns, text literals for enumerations (quotes may
be left out), numbers, ``true`` and ``false``, ``&& || !``, comparisons,
``+ - * sqrt``, ``in_<area>`` and ``edge.getDistance()``.  Other direction and
previous edge are reached as ``backward_<name>`` and ``prev_<name>``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What each list starts from.
START = {"speed": 999.0, "priority": 1.0, "turn_penalty": 0.0}
OPERATIONS = ("multiply_by", "limit_to", "add")
_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?)|(&&|\|\||==|!=|<=|>=|[!<>()+*-])|(edge\.getDistance\(\))|([A-Za-z_][\w.]*)|'([^']*)'|\"([^\"]*)\")")


class RuleError(ValueError):
    """A model that cannot be compiled."""


@dataclass
class Context:
    """Names a model may use: columns with their kind (number, boolean or enum with its values) and areas."""

    columns: dict[str, str]
    enums: dict[str, set[str]] = field(default_factory=dict)
    areas: dict[str, Column] = field(default_factory=dict)
    distance: Column | None = None
    rename: dict[str, str] = field(default_factory=dict)  # e.g. backward_x -> the column of the other direction


class _Parser:
    """Precedence climbing over tokens; values are (Column, kind)."""

    LEVELS = (("||",), ("&&",), ("==", "!="), ("<", "<=", ">", ">="), ("+", "-"), ("*",))

    def __init__(self, text: str, ctx: Context):
        self.text, self.ctx, self.tokens, i = text, ctx, [], 0
        while i < len(text.rstrip()):
            m = _TOKEN.match(text, i)
            if not m:
                raise RuleError(f"cannot read {text[i:]!r}")
            self.tokens.append(next((k, v) for k, v in zip(("num", "op", "dist", "name", "text", "text"), m.groups()) if v is not None))
            i = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] == "op" else None

    def run(self) -> tuple[Column, str]:
        out = self.level(0)
        if self.at != len(self.tokens):
            raise RuleError(f"unexpected {self.tokens[self.at][1]!r} in {self.text!r}")
        return out

    def level(self, n: int) -> tuple[Column, str]:
        if n == len(self.LEVELS):
            return self.unary()
        left = self.level(n + 1)
        while (op := self.peek()) in self.LEVELS[n]:
            self.at += 1
            left = self.join(op, left, self.level(n + 1))
        return left

    def join(self, op: str, a: tuple, b: tuple) -> tuple[Column, str]:
        (x, kx), (y, ky) = a, b
        if op in ("||", "&&"):
            if kx != "boolean" or ky != "boolean":
                raise RuleError(f"{op} needs conditions in {self.text!r}")
            return (x | y if op == "||" else x & y), "boolean"
        if kx.startswith("enum") or ky.startswith("enum"):
            if op not in ("==", "!="):
                raise RuleError(f"enumerations allow == and != only in {self.text!r}")
            name = kx[5:] if kx.startswith("enum:") else ky[5:]
            literal = y if ky == "word" else x if kx == "word" else None
            if literal is not None and name in self.ctx.enums and literal not in self.ctx.enums[name]:
                raise RuleError(f"{literal!r} is no value of {name}")
            x, y = (F.lit(v) if isinstance(v, str) else v for v in (x, y))
            return (x == y if op == "==" else x != y), "boolean"
        if "word" in (kx, ky):
            raise RuleError(f"unknown name in {self.text!r}")
        if op in ("==", "!="):
            return (x == y if op == "==" else x != y), "boolean"
        if kx != "number" or ky != "number":
            raise RuleError(f"{op} needs numbers in {self.text!r}")
        made = {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y, "+": x + y, "-": x - y, "*": x * y}[op]
        return made, "boolean" if op in ("<", "<=", ">", ">=") else "number"

    def unary(self) -> tuple[Column, str]:
        if self.at >= len(self.tokens):
            raise RuleError(f"{self.text!r} ends early")
        kind, v = self.tokens[self.at]
        self.at += 1
        if kind == "num":
            return F.lit(float(v)), "number"
        if kind == "text":
            return v, "word"
        if kind == "dist":
            if self.ctx.distance is None:
                raise RuleError("this context has no distance")
            return self.ctx.distance, "number"
        if v == "!":
            x, k = self.unary()
            if k != "boolean":
                raise RuleError("! needs a condition")
            return ~x, "boolean"
        if v == "-":
            x, k = self.unary()
            if k != "number":
                raise RuleError("- needs a number")
            return -x, "number"
        if v == "(":
            out = self.level(0)
            if self.peek() != ")":
                raise RuleError(f"missing ) in {self.text!r}")
            self.at += 1
            return out
        if kind == "name":
            return self.name(v)
        raise RuleError(f"unexpected {v!r} in {self.text!r}")

    def name(self, v: str) -> tuple[Column, str]:
        if v in ("true", "false"):
            return F.lit(v == "true"), "boolean"
        if v in ("sqrt", "abs") and self.peek() == "(":
            x, k = self.unary()
            if k != "number":
                raise RuleError(f"{v} needs a number")
            return (F.sqrt(x) if v == "sqrt" else F.abs(x)), "number"
        if v.startswith("in_") and v[3:] in self.ctx.areas:
            return self.ctx.areas[v[3:]], "boolean"
        base = re.sub(r"^(?:backward_|prev_)", "", v)
        column = self.ctx.rename.get(v, v)
        kind = self.ctx.columns.get(v) or (self.ctx.columns.get(base) if v in self.ctx.rename else None)
        if kind is None:
            if v.startswith(("in_", "backward_", "prev_")):
                raise RuleError(f"unknown name {v!r}")
            return v, "word"
        return F.col(column), f"enum:{base}" if kind == "enum" else kind


def condition(text: str, ctx: Context) -> Column:
    """A condition as a boolean column; what compares with null does not hold."""
    c, kind = _Parser(text, ctx).run()
    if kind != "boolean":
        raise RuleError(f"{text!r} is no condition")
    return F.coalesce(c, F.lit(False))


def value(text: str | float, ctx: Context) -> Column:
    c, kind = _Parser(str(text), ctx).run()
    if kind != "number":
        raise RuleError(f"{text!r} is no number")
    return c


def groups(statements: list[dict]) -> list[list[dict]]:
    """Statements split where an ``if`` opens a new group."""
    out: list[list[dict]] = []
    for s in statements:
        if "if" in s:
            out.append([s])
        elif not out:
            raise RuleError("a group starts with if")
        elif "else" in out[-1][-1]:
            raise RuleError("nothing may follow else in a group")
        else:
            out[-1].append(s)
    return out


def fold(statements: list[dict], start: Column, ctx: Context, allowed: tuple[str, ...] = OPERATIONS) -> Column:
    """The value after all groups have acted on ``start``."""
    out = start
    for group in groups(statements):
        chain = None
        for s in group:
            ops = [k for k in (*OPERATIONS, "do") if k in s]
            if len(ops) != 1:
                raise RuleError(f"one operation each, not {ops}")
            op = ops[0]
            if op == "do":
                made = fold(s["do"], out, ctx, allowed)
            elif op not in allowed:
                raise RuleError(f"{op} is not allowed here")
            else:
                v = value(s[op], ctx)
                made = out * v if op == "multiply_by" else F.least(out, v) if op == "limit_to" else out + v
            if "else" in s:
                chain = made if chain is None else chain.otherwise(made)
                break
            cond = condition(s.get("if") or s.get("else_if") or "", ctx)
            chain = F.when(cond, made) if chain is None else chain.when(cond, made)
        else:
            chain = chain.otherwise(out)
        out = chain
    return out


@dataclass
class Compiled:
    """Columns of a model: speed in km/h, priority, turn penalty, and its settings."""

    speed: Column
    priority: Column
    turn_penalty: Column
    distance_influence: float
    heading_penalty: float


def merge(base: dict, query: dict | None) -> dict:
    """Rules of both models, the base first; settings of the query win; areas of equal name are an error."""
    if not query:
        return base
    clash = set(base.get("areas", {})) & set(query.get("areas", {}))
    if clash:
        raise RuleError(f"areas defined twice: {sorted(clash)}")
    out = {k: [*base.get(k, []), *query.get(k, [])] for k in ("speed", "priority", "turn_penalty")}
    out["areas"] = {**base.get("areas", {}), **query.get("areas", {})}
    for k in ("distance_influence", "heading_penalty"):
        if (v := query.get(k, base.get(k))) is not None:
            out[k] = v
    return out


def compile_model(model: dict, ctx: Context) -> Compiled:
    """Check and compile a model.

    The first speed group must bound the speed for every edge.  Priorities are
    not added to; turn penalties are only added to, without blocks.
    """
    speed = groups(model.get("speed", []))
    first = speed[0] if speed else None
    if not first or not (("limit_to" in first[0] and first[0].get("if") == "true" and len(first) == 1) or ("else" in first[-1] and "limit_to" in first[-1])):
        raise RuleError("the first speed group must be one unconditional limit_to or end with else limit_to")
    if any("do" in s for s in model.get("turn_penalty", [])):
        raise RuleError("turn_penalty allows no blocks")
    return Compiled(
        fold(model["speed"], F.lit(START["speed"]), ctx, ("multiply_by", "limit_to", "add")),
        fold(model.get("priority", []), F.lit(START["priority"]), ctx, ("multiply_by", "limit_to")),
        fold(model.get("turn_penalty", []), F.lit(START["turn_penalty"]), ctx, ("add",)),
        float(model.get("distance_influence", 0)),
        float(model.get("heading_penalty", 120)),
    )


def edge_weight(m: Compiled, distance_m: Column, unfavoured: Column | None = None) -> Column:
    """distance / speed in seconds, over priority, plus influence; null (unusable) where speed or priority is zero."""
    seconds = distance_m / m.speed * 3.6
    if unfavoured is not None:
        seconds = seconds + F.when(unfavoured, m.heading_penalty).otherwise(0.0)
    return F.when((m.speed > 0) & (m.priority > 0), seconds / m.priority + distance_m * m.distance_influence / 1000)


def edge_millis(m: Compiled, distance_m: Column) -> Column:
    """Travel time of an edge, rounded to milliseconds by edge."""
    return F.when(m.speed > 0, F.round(distance_m / m.speed * 3600).cast("bigint"))
