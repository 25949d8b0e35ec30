"""Bins, ranges, guarded arithmetic, flags and sampling numbers as Column expressions."""

from __future__ import annotations

import ast
import re
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform_bin(x: Column, low: float, high: float, bins: int, close_top: bool = False) -> Column:
    """1-based bin of [low, high) in equal steps, 0 below and bins + 1 above; close_top puts high in the last bin. Null
    and NaN have no bin."""
    k = F.floor((x - low) * (bins / (high - low))).cast("int") + 1
    top = F.when(x == high, F.lit(bins)) if close_top else F.when(x == high, F.lit(bins + 1))
    inside = F.coalesce(top, F.when(x > high, bins + 1).otherwise(F.least(k, F.lit(bins))))
    return F.when(x.isNotNull() & ~F.isnan(x), F.when(x < low, 0).otherwise(inside)).cast("int")


def edge_bin(x: Column, edges: list[float]) -> Column:
    """Number of edges at or below x, for edges of any width: 0 below the first, len(edges) from the last on."""
    return F.when(x.isNotNull(), F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= x)))


def bin_low(k: Column, low: float, high: float, bins: int) -> Column:
    return F.lit(low) + (k - 1) * F.lit((high - low) / bins)


def clamp_scale(x: Column, mean: Column | float, std: Column | float, low: float, high: float) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    scaled = F.try_divide(x - lit(mean), lit(std))
    return F.when(scaled.isNotNull(), F.least(F.greatest(scaled, F.lit(float(low))), F.lit(float(high))))


def guarded(a: Column, b: Column, default: float = 0.0) -> Column:
    """a / b, or the default where b is 0 or null."""
    return F.coalesce(F.try_divide(a, b), F.lit(default))


def is_normal(x: Column) -> Column:
    """Neither null, NaN, infinite, zero nor subnormal."""
    a = F.abs(x.cast("double"))
    return F.coalesce(~F.isnan(a) & (a >= F.lit(2.2250738585072014e-308)) & (a < F.lit(float("inf"))), F.lit(False))


def significance(x: Column, error: Column, default: float = 0.0) -> Column:
    """abs(x) over its error where the error is a normal positive number."""
    return F.when(is_normal(error) & (error > 0), F.abs(x) / error).otherwise(F.lit(default))


def rounded(x: Column, digits: int) -> Column:
    """x rounded half away from 0; a negative number that becomes 0 keeps its sign, as it does where rounding scales x."""
    return F.signum(x) * F.round(F.abs(x), digits)


def exact_sum(x: Column) -> Column:
    """Sum of doubles that does not hang on the order of the rows: they are added as decimals, which hold ten digits after
    the point. Where a group has one that no such decimal holds, as NaN, or the total has no room, it is the plain sum."""
    parts = x.try_cast("decimal(38,10)")
    return F.coalesce(F.when(F.count(parts) == F.count(x), F.try_sum(parts).cast("double")), F.sum(x))


def significant_digits(x: Column, digits: int = 4) -> Column:
    return F.format_string(f"%.{digits - 1}e", x).cast("double")


def ratio_score(p: Column, q: Column) -> Column:
    """p over p + q, 0 where p is not positive."""
    return F.when(p > 0, p / (p + q)).otherwise(F.lit(0.0))


def bit(flags: Column, k: int) -> Column:
    return F.getbit(flags, F.lit(k)) == 1


def pack_bits(decisions: list[Column]) -> Column:
    """Bit set of boolean columns, the first at bit 0; 16 at most."""
    if len(decisions) > 16:
        raise ValueError("a bit set holds 16 decisions")
    total = F.lit(0)
    for k, d in enumerate(decisions):
        total = total + F.shiftleft(F.coalesce(d, F.lit(False)).cast("int"), k)
    return total


def uniform(seed: int, *key: Column) -> Column:
    """Number in [0, 1) that depends on the seed and key alone, whatever the partitioning."""
    text = F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in key])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


class Interval(NamedTuple):
    """Range with open or closed ends."""

    low: float
    high: float
    low_closed: bool = True
    high_closed: bool = False

    @classmethod
    def parse(cls, text: str) -> Interval:
        m = re.fullmatch(r"\s*([\[(])\s*([^:\s]+)\s*:\s*([^:\s]+)\s*([\])])\s*", text)
        if not m:
            raise ValueError(f"not a range: {text!r}")
        low, high = float(m[2]), float(m[3])
        if low > high:
            raise ValueError(f"ends out of order: {text!r}")
        return cls(low, high, m[1] == "[", m[4] == "]")

    def contains(self, x: Column) -> Column:
        above = x >= self.low if self.low_closed else x > self.low
        below = x <= self.high if self.high_closed else x < self.high
        return above & below

    def overlaps(self, other: Interval) -> bool:
        first, second = sorted((self, other), key=lambda r: (r.low, not r.low_closed))
        return second.low < first.high or (second.low == first.high and first.high_closed and second.low_closed)

    def combined(self, other: Interval) -> Interval:
        low = min((self.low, not self.low_closed), (other.low, not other.low_closed))
        high = max((self.high, self.high_closed), (other.high, other.high_closed))
        return Interval(low[0], high[0], not low[1], high[1])

    @classmethod
    def around(cls, value: float, down: float, up: float) -> Interval:
        """Absolute range of one that is relative to a value: from value + down to value + up."""
        if down > 0 or up < 0:
            raise ValueError(f"a relative range holds 0: {down} {up}")
        return cls(value + down, value + up, True, True)

    def scaled(self, by: float) -> Interval:
        """Absolute range of one that is relative to `by`."""
        return Interval(self.low * by, self.high * by, self.low_closed, self.high_closed)


def grid(text: str) -> list[float]:
    """Points of 'a:b:step', 'a:b|points' or 'a:b/bins' (edges)."""
    if m := re.fullmatch(r"([^:|/]+):([^:|/]+):([^:|/]+)", text):
        low, high, step = map(float, m.groups())
        return [low + i * step for i in range(int((high - low) / step + 1e-9) + 1)]
    if m := re.fullmatch(r"([^:|/]+):([^:|/]+)([|/])(\d+)", text):
        low, high, n = float(m[1]), float(m[2]), int(m[4]) - (m[3] == "|")
        return [low + (high - low) * i / n for i in range(n + 1)] if n else [low]
    raise ValueError(f"not a grid: {text!r}")


def log_loss(y: Column, p: Column, epsilon: float = 1e-7) -> Column:
    q = F.least(F.greatest(p, F.lit(epsilon)), F.lit(1 - epsilon))
    return -(y * F.log(q) + (F.lit(1.0) - y) * F.log(F.lit(1.0) - q))


def focal_loss(y: Column, p: Column, gamma: float = 2.0, epsilon: float = 1e-7) -> Column:
    q = F.least(F.greatest(p, F.lit(epsilon)), F.lit(1 - epsilon))
    return -(y * F.pow(1 - q, F.lit(gamma)) * F.log(q) + (1 - y) * F.pow(q, F.lit(gamma)) * F.log(1 - q))


def on_circle(x: Column, low: float, high: float, period: float = 6.283185307179586) -> Column:
    """Whether an angle lies in the closed arc from low up to high, however either is turned."""
    width = (high - low) % period if high - low < period else period
    return F.pmod(x - low, F.lit(period)) <= width


def formula(text: str, **values: Column) -> Column:
    """Column of an arithmetic formula over named columns, such as 'x * (1 + y / 2)', with functions of one or two numbers
    (sqrt, exp, log, pow, ...). A division by 0 is null. Other syntax is an error."""
    kinds = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: F.try_divide, ast.Pow: F.pow}
    known = {n: getattr(F, n) for n in ("sqrt", "exp", "log", "log10", "pow", "abs", "sin", "cos", "tan", "tanh", "least", "greatest")}

    def build(n: ast.AST) -> Column:
        match n:
            case ast.BinOp() if type(n.op) in kinds:
                return kinds[type(n.op)](build(n.left), build(n.right))
            case ast.UnaryOp(op=ast.USub()):
                return -build(n.operand)
            case ast.Call(func=ast.Name(id=name)) if name in known:
                return known[name](*map(build, n.args))
            case ast.Name(id=name) if name in values:
                return values[name].cast("double")
            case ast.Constant(value=int() | float() as number):
                return F.lit(float(number))
        raise ValueError(f"not a formula: {text!r}")

    return build(ast.parse(text.strip(), mode="eval").body)


def precision(x: Column, bits: int) -> Column:
    """x rounded to so many bits of its mantissa; 0 and null stay."""
    step = F.pow(F.lit(2.0), F.floor(F.log2(F.abs(x))) - bits)
    return F.when(x == 0, x).otherwise(F.floor(x / step + 0.5) * step)


def working_point_loss(target: Column, other: Column, score: Column, other_score: Column, points: list[float], gamma: float = 2.0, epsilon: float = 1e-7) -> Column:
    """Focal loss of a ratio score, weighted up by how many working points a true row misses and another row passes,
    each counted by a smooth step. target and other are 0 or 1."""
    d = F.least(F.greatest(score / (score + other_score + epsilon), F.lit(epsilon)), F.lit(1 - epsilon))
    missed = sum(((1 - F.tanh(40 * (d - p))) / 2 for p in points), F.lit(0.0)) / len(points)
    passed = sum(((1 + F.tanh(40 * (d - p))) / 2 for p in points), F.lit(0.0)) / len(points)
    return -(1 + passed) * other * F.pow(d, F.lit(gamma)) * F.log(1 - d) - (1 + missed) * target * F.pow(1 - d, F.lit(gamma)) * F.log(d)
