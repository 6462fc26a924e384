"""User expressions compiled to Columns: probability predicates and motion predicates over frame arrays.

Nothing is evaluated in Python: an expression is parsed, each node is translated or refused with
ValueError, and Catalyst runs the result. Motion expressions are typed: a value is a scalar or an
array, and arithmetic spreads scalars over arrays as numpy does.
"""

from __future__ import annotations

import ast
import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_COMPARE: dict[type, Callable] = {
    ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b,
    ast.GtE: lambda a, b: a >= b, ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b,
}


def _parse(expression: str) -> ast.expr:
    try:
        return ast.parse(expression.strip(), mode="eval").body
    except (SyntaxError, ValueError) as e:
        raise ValueError(f"cannot parse {expression!r}") from e


def _number(node: ast.Constant) -> float:
    if isinstance(node.value, bool) or not isinstance(node.value, (int, float)):
        raise ValueError("only numeric literals are allowed")
    return float(node.value)


@functools.lru_cache(128)
def probability(expression: str, column: str = "p") -> Column:
    """Comparisons of ``p`` with numbers, chained or combined by and/or/not, ``& | ^ ~``.

    Arithmetic other than a sign is refused.
    """

    def value(n: ast.expr) -> Column:
        if isinstance(n, ast.Constant):
            return F.lit(_number(n))
        if isinstance(n, ast.Name) and n.id == "p":
            return F.col(column).cast("double")
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.USub):
            return -value(n.operand)
        raise ValueError(f"not a number: {ast.dump(n)}")

    def truth(n: ast.expr) -> Column:
        if isinstance(n, ast.Compare):
            sides = [value(x) for x in (n.left, *n.comparators)]
            tests = []
            for op, a, b in zip(n.ops, sides, sides[1:], strict=False):
                if type(op) not in _COMPARE:
                    raise ValueError(f"comparison {type(op).__name__} is not allowed")
                tests.append(_COMPARE[type(op)](a, b))
            return functools.reduce(lambda a, b: a & b, tests)
        if isinstance(n, ast.BoolOp):
            join = (lambda a, b: a & b) if isinstance(n.op, ast.And) else (lambda a, b: a | b)
            return functools.reduce(join, map(truth, n.values))
        if isinstance(n, ast.BinOp) and isinstance(n.op, (ast.BitAnd, ast.BitOr, ast.BitXor)):
            a, b = truth(n.left), truth(n.right)
            return a & b if isinstance(n.op, ast.BitAnd) else a | b if isinstance(n.op, ast.BitOr) else a != b
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, (ast.Not, ast.Invert)):
            return ~truth(n.operand)
        raise ValueError(f"{type(n).__name__} is not allowed here")

    return truth(_parse(expression))


@dataclass
class _Value:
    """A compiled node: an array or a scalar, of numbers or truth values; ``indices`` is the result of where()."""

    col: Column
    array: bool = False
    truth: bool = False
    indices: bool = False

    def number(self) -> _Value:
        if not self.truth:
            return self
        return _Value(F.transform(self.col, lambda x: x.cast("double")) if self.array else self.col.cast("double"), self.array)

    def boolean(self) -> Column:
        if self.array:
            raise ValueError("an array has no single truth value; use any() or all()")
        return self.col if self.truth else self.col != 0


#: Names that a motion expression may use (fixed values of the query language).
VARIABLES = ("speed", "acceleration", "jerk", "curvature", "speed_kph")

#: Named motion patterns (fixed values of the query language).
PATTERNS = {
    "high_curvature": "sum(curvature > 0.15) > 10",
    "stop_go": "any(speed < 0.5) and any(speed > 3.0) and min(where(speed > 3.0)[0]) > min(where(speed < 0.5)[0])",
    "hard_braking": "sum(acceleration < -3.0) > 10",
    "prolonged_stop": "sum(speed < 0.5) > 150",
    "idle_to_cruise": "any(speed < 0.5) and any(speed > 10.0) and min(where(speed > 10.0)[0]) > min(where(speed < 0.5)[0])",
    "high_speed_swerve": "sum(curvature > 0.2) > 10 and sum(speed_kph > 50) > 10",
    "moving_ego": "sum(speed_kph > 5) > 10",
}


def _zip(a: _Value, b: _Value, f: Callable, truth: bool = False) -> _Value:
    a, b = (a, b) if truth and a.truth and b.truth else (a.number(), b.number())
    if a.array and b.array:
        return _Value(F.zip_with(a.col, b.col, f), True, truth)
    if a.array:
        return _Value(F.transform(a.col, lambda x: f(x, b.col)), True, truth)
    if b.array:
        return _Value(F.transform(b.col, lambda x: f(a.col, x)), True, truth)
    return _Value(f(a.col, b.col), False, truth)


def _each(a: _Value, f: Callable) -> _Value:
    a = a.number()
    return _Value(F.transform(a.col, f), True) if a.array else _Value(f(a.col))


def _fold(a: _Value) -> Column:
    a = a.number()
    if not a.array:
        return F.array(a.col)
    return a.col


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda s, x: s + x)


def _mean(c: Column) -> Column:
    return F.when(F.size(c) > 0, _sum(c) / F.size(c))


def _var(c: Column) -> Column:
    m = _mean(c)
    return _mean(F.transform(c, lambda x: (x - m) * (x - m)))


def _quantile(c: Column, q: Column) -> Column:
    """Linear interpolation between order statistics; q in percent."""
    s, at = F.array_sort(c), (F.size(c) - 1) * q / 100
    low = F.floor(at).cast("int")
    a, b = F.get(s, low), F.get(s, F.least(low + 1, F.size(c) - 1))
    return a + (b - a) * (at - low)


def _gradient(c: Column) -> Column:
    """Central differences, one-sided at the ends; one element gives null."""
    n = F.size(c)
    mid = F.transform(c, lambda x, i: (F.get(c, F.least(i + 1, n - 1)) - F.get(c, F.greatest(i - 1, F.lit(0)))) / F.when((i == 0) | (i == n - 1), 1.0).otherwise(2.0))
    return F.when(n > 1, mid)


def _call(name: str, args: list[_Value]) -> _Value:
    def need(*counts: int) -> None:
        if len(args) not in counts:
            raise ValueError(f"{name}() takes {' or '.join(map(str, counts))} arguments")

    plain = {
        "mean": _mean, "min": F.array_min, "max": F.array_max, "sum": _sum, "var": _var,
        "std": lambda c: F.sqrt(_var(c)), "median": lambda c: _quantile(c, F.lit(50.0)),
        "ptp": lambda c: F.array_max(c) - F.array_min(c),
        "argmin": lambda c: (F.array_position(c, F.array_min(c)) - 1).cast("double"),
        "argmax": lambda c: (F.array_position(c, F.array_max(c)) - 1).cast("double"),
        "count_nonzero": lambda c: F.size(F.filter(c, lambda x: x != 0)).cast("double"),
        "len": lambda c: F.size(c).cast("double"),
    }
    if name in plain:
        need(1)
        return _Value(plain[name](_fold(args[0])))
    if name in ("any", "all"):
        need(1)
        f = F.exists if name == "any" else F.forall
        return _Value(f(_fold(args[0]), lambda x: x != 0), truth=True)
    if name in ("abs", "sqrt", "sign"):
        need(1)
        return _each(args[0], {"abs": F.abs, "sqrt": F.sqrt, "sign": F.signum}[name])
    if name == "round":
        need(1, 2)
        places = 0
        if len(args) == 2:
            raise ValueError("round() takes one argument here")
        return _each(args[0], lambda x: F.bround(x, places))
    if name == "clip":
        need(3)
        return _zip(_zip(args[0], args[1], lambda x, y: F.greatest(x, y)), args[2], lambda x, y: F.least(x, y))
    if name in ("maximum", "minimum"):
        need(2)
        return _zip(*args, (lambda x, y: F.greatest(x, y)) if name == "maximum" else (lambda x, y: F.least(x, y)))
    if name in ("logical_and", "logical_or"):
        need(2)
        join = (lambda x, y: (x != 0) & (y != 0)) if name == "logical_and" else (lambda x, y: (x != 0) | (y != 0))
        a, b = args[0].number(), args[1].number()
        return _zip(a, b, join, True)
    if name == "diff":
        need(1)
        c = _fold(args[0])
        return _Value(F.when(F.size(c) > 1, F.transform(F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(1))), lambda x, i: x - F.get(c, i))).otherwise(F.array().cast("array<double>")), True)
    if name == "gradient":
        need(1)
        return _Value(_gradient(_fold(args[0])), True)
    if name == "percentile":
        need(2)
        return _Value(_quantile(_fold(args[0]), args[1].number().col))
    if name == "where":
        need(1, 3)
        if len(args) == 3:
            cond, a, b = args[0].number(), args[1].number(), args[2].number()
            picked = _zip(cond, a, lambda c, x: F.when(c != 0, x))
            return _zip(picked, _zip(cond, b, lambda c, y: F.when(c == 0, y)), lambda x, y: F.coalesce(x, y))
        c = _fold(args[0])
        at = F.filter(F.transform(c, lambda x, i: F.when(x != 0, i.cast("double"))), lambda x: x.isNotNull())
        return _Value(at, True, indices=True)
    raise ValueError(f"unknown function {name!r}")


_FUNCTIONS = frozenset(
    "mean min max sum all any abs std var median diff where clip sqrt argmin argmax percentile count_nonzero logical_and logical_or gradient maximum minimum ptp sign round len".split()
)


@functools.lru_cache(128)
def motion(expression: str, frames: str = "frames") -> Column:
    """A predicate over the frames column (array of structs with the motion channels).

    An operation on no elements (the least of none, say) is null, and a null predicate keeps nothing.
    """

    def channel(name: str) -> Column:
        field = "speed" if name == "speed_kph" else name
        factor = 3.6 if name == "speed_kph" else 1.0
        return F.transform(F.col(frames), lambda f: f[field].cast("double") * factor)

    def walk(n: ast.expr) -> _Value:
        if isinstance(n, ast.Constant):
            return _Value(F.lit(_number(n)))
        if isinstance(n, ast.Name):
            if n.id not in VARIABLES:
                raise ValueError(f"unknown name {n.id!r}")
            return _Value(channel(n.id), True)
        if isinstance(n, ast.Call):
            if not isinstance(n.func, ast.Name) or n.func.id not in _FUNCTIONS or n.keywords:
                raise ValueError("only direct calls of known functions with positional arguments are allowed")
            return _call(n.func.id, [walk(a) for a in n.args])
        if isinstance(n, ast.Subscript):
            return subscript(walk(n.value), n.slice)
        if isinstance(n, ast.Compare):
            sides = [walk(x) for x in (n.left, *n.comparators)]
            tests = []
            for op, a, b in zip(n.ops, sides, sides[1:], strict=False):
                if type(op) not in _COMPARE:
                    raise ValueError(f"comparison {type(op).__name__} is not allowed")
                tests.append(_zip(a.number(), b.number(), _COMPARE[type(op)], True))
            out = tests[0]
            for t in tests[1:]:
                out = _Value(out.boolean() & t.boolean(), truth=True)
            return out
        if isinstance(n, ast.BoolOp):
            join = (lambda a, b: a & b) if isinstance(n.op, ast.And) else (lambda a, b: a | b)
            return _Value(functools.reduce(join, [walk(v).boolean() for v in n.values]), truth=True)
        if isinstance(n, ast.UnaryOp):
            v = walk(n.operand)
            if isinstance(n.op, ast.Not):
                return _Value(~v.boolean(), truth=True)
            if isinstance(n.op, ast.Invert):
                if not v.truth:
                    raise ValueError("~ needs a truth value")
                return _Value(F.transform(v.col, lambda x: ~x), True, True) if v.array else _Value(~v.col, truth=True)
            return _each(v, lambda x: -x) if isinstance(n.op, ast.USub) else v.number()
        if isinstance(n, ast.BinOp):
            return binary(type(n.op), walk(n.left), walk(n.right))
        raise ValueError(f"{type(n).__name__} is not allowed")

    def binary(op: type, a: _Value, b: _Value) -> _Value:
        if op in (ast.BitAnd, ast.BitOr, ast.BitXor):
            if not (a.truth and b.truth):
                raise ValueError("& | ^ need truth values")
            return _zip(a, b, {ast.BitAnd: lambda x, y: x & y, ast.BitOr: lambda x, y: x | y, ast.BitXor: lambda x, y: x != y}[op], True)
        ops: dict[type, Callable] = {
            ast.Add: lambda x, y: x + y, ast.Sub: lambda x, y: x - y, ast.Mult: lambda x, y: x * y,
            ast.Div: lambda x, y: F.try_divide(x, y), ast.FloorDiv: lambda x, y: F.floor(F.try_divide(x, y)).cast("double"),
            ast.Mod: lambda x, y: x - y * F.floor(F.try_divide(x, y)), ast.Pow: F.pow,
        }
        if op not in ops:
            raise ValueError(f"operator {op.__name__} is not allowed")
        return _zip(a, b, ops[op])

    def subscript(v: _Value, at: ast.expr) -> _Value:
        sign = 1
        if isinstance(at, ast.UnaryOp) and isinstance(at.op, ast.USub):
            sign, at = -1, at.operand
        if not isinstance(at, ast.Constant) or not isinstance(at.value, int):
            raise ValueError("only whole numbers may be indices")
        if v.indices:
            if at.value != 0:
                raise ValueError("where() has one axis")
            return _Value(v.col, True)
        k = sign * at.value
        return _Value(F.get(v.col, F.lit(k) if k >= 0 else F.size(v.col) + k), truth=v.truth)

    return F.coalesce(walk(_parse(expression)).boolean(), F.lit(False))


def pattern(name: str, extra: str | None = None, frames: str = "frames") -> Column:
    """A named pattern, and an expression of the user's own where given."""
    if name not in PATTERNS:
        raise ValueError(f"unknown pattern {name!r}")
    return motion(PATTERNS[name], frames) & motion(extra, frames) if extra else motion(PATTERNS[name], frames)
