"""Arithmetic formulas given by an operator, compiled to columns and never evaluated as code."""

from __future__ import annotations

import ast
import itertools
import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The default formulas and the limits of the language.
SEARCH_DEFAULT = "4*P1+2*P2+(K+1)/(K+L)+(K+1)/(K+V)"
PRODUCT_DEFAULT = "2*L1+L2+100*L3"
LONGEST, MOST_NODES = 200, 64
SYMBOLS = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/"}


class FormulaError(ValueError):
    """The formula is outside the language or not defined everywhere; its text is not repeated."""


class Formula:
    """A checked formula over ``names``: numbers, names, + - * / and signs, nothing else."""

    def __init__(self, source: str, names: Sequence[str]):
        if not isinstance(source, str) or not 0 < len(source.strip()) or len(source) > LONGEST:
            raise FormulaError(f"a formula has 1 to {LONGEST} characters")
        try:
            tree = ast.parse(source.strip(), mode="eval")
        except (SyntaxError, ValueError):
            raise FormulaError("not an arithmetic expression") from None
        if len(list(ast.walk(tree))) > MOST_NODES:
            raise FormulaError("too many parts")
        self.names, self.root = tuple(names), tree.body
        self._fold(self.root, lambda value: value, lambda name: 0.0, lambda op, a, b: 0.0, lambda minus, a: 0.0)

    def _fold(self, node, number, name, binary, sign):
        """Walk the expression with one function for each kind of node; anything else is an error."""
        again = lambda n: self._fold(n, number, name, binary, sign)
        match node:
            case ast.Constant(value=value) if type(value) in (int, float):
                return number(float(value))
            case ast.Name(id=word) if word in self.names:
                return name(word)
            case ast.BinOp(left=left, op=op, right=right) if type(op) in SYMBOLS:
                return binary(SYMBOLS[type(op)], again(left), again(right))
            case ast.UnaryOp(op=ast.UAdd() | ast.USub() as op, operand=operand):
                return sign(isinstance(op, ast.USub), again(operand))
        raise FormulaError("a formula has numbers, names and + - * / only")

    def value(self, **given: float) -> float:
        """The value in Python; a division by zero is an error."""

        def binary(op, a, b):
            return a + b if op == "+" else a - b if op == "-" else a * b if op == "*" else a / b

        return self._fold(self.root, lambda v: v, lambda n: float(given[n]), binary, lambda minus, a: -a if minus else a)

    def column(self, given: Mapping[str, Column | float]) -> Column:
        """A double column; a division by zero gives null, also under ANSI rules."""

        def leaf(n):
            v = given[n]
            return v.cast("double") if isinstance(v, Column) else F.lit(float(v))

        def binary(op, a, b):
            return a + b if op == "+" else a - b if op == "-" else a * b if op == "*" else F.try_divide(a, b)

        return self._fold(self.root, F.lit, leaf, binary, lambda minus, a: -a if minus else a)

    def sql(self, given: Mapping[str, str]) -> str:
        def binary(op, a, b):
            return f"({a} / nullif({b}, 0))" if op == "/" else f"({a} {op} {b})"

        return self._fold(self.root, lambda v: f"CAST({v!r} AS DOUBLE)", lambda n: f"CAST({given[n]} AS DOUBLE)", binary, lambda minus, a: f"(-{a})" if minus else a)

    def check(self, grid: Mapping[str, Sequence[float]], lowest: float = -math.inf, highest: Mapping[str, float] | None = None) -> Formula:
        """Evaluate at all points of ``grid``: every value must be finite, not under ``lowest`` and not over the value at
        the point ``highest``, which must be positive."""
        points = [dict(zip(grid, p)) for p in itertools.product(*grid.values())]
        try:
            values = [self.value(**p) for p in ([highest] if highest else []) + points]
        except (ZeroDivisionError, OverflowError):
            raise FormulaError("the formula is not defined everywhere") from None
        if not all(map(math.isfinite, values)):
            raise FormulaError("the formula is not finite everywhere")
        if highest and (values[0] <= 0 or max(values) > values[0] + SLACK):
            raise FormulaError("the best value must be positive and the highest")
        if min(values) < lowest:
            raise FormulaError("the formula leaves its range")
        return self


# Points at which formulas are checked (ranks with none at all, shares of a flag, counts), and the rounding
# allowed in a comparison.
CHECKED_RANKS, CHECKED_FLAGS, CHECKED_COUNTS, SLACK = (1, 2, 10, 1000, math.inf), (0, 0.5, 1), (0, 1, 2, 1000), 1e-9


def search_formula(source: str = SEARCH_DEFAULT, k: float = 10) -> Formula:
    """A fragment score over P1, P2 in {0, 1} and the ranks L, V (infinite where there is none), between 0 and its value
    at P1 = P2 = L = V = 1."""
    points = {"P1": CHECKED_FLAGS, "P2": CHECKED_FLAGS, "L": CHECKED_RANKS, "V": CHECKED_RANKS, "K": (k,)}
    return Formula(source, tuple(points)).check(points, 0, {"P1": 1, "P2": 1, "L": 1, "V": 1, "K": k})


def product_formula(source: str = PRODUCT_DEFAULT) -> Formula:
    """A product score over the counts L1, L2, L3, finite for every count."""
    return Formula(source, ("L1", "L2", "L3")).check(dict.fromkeys(("L1", "L2", "L3"), CHECKED_COUNTS))
