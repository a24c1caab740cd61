"""Element-wise mathematics as Column expressions with IEEE results where SQL would raise or give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF, NAN = float("inf"), float("nan")


def _d(c: Column) -> Column:
    return c.cast("double")


def divide(a: Column, b: Column) -> Column:
    """IEEE division: x / 0 is an infinity of x's sign, 0 / 0 is NaN."""
    x = _d(a)
    return F.when(_d(b) != 0, F.try_divide(x, _d(b))).otherwise(F.when(b.isNotNull(), F.when(x > 0, INF).when(x < 0, -INF).when(x.isNotNull(), NAN)))


def log(c: Column, base: str = "e") -> Column:
    """Logarithm with -inf at 0 and NaN below."""
    f = {"e": F.ln, "2": F.log2, "10": F.log10, "1p": F.log1p}[base]
    edge = -1 if base == "1p" else 0
    return F.when(_d(c) > edge, f(_d(c))).when(_d(c) == edge, F.lit(-INF)).when(c.isNotNull(), F.lit(NAN))


UNARY = {
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "arcsin": F.asin, "arccos": F.acos, "arctan": F.atan, "sinh": F.sinh,
    "cosh": F.cosh, "tanh": F.tanh, "exp": F.exp, "exp2": lambda c: F.pow(F.lit(2.0), c), "expm1": F.expm1,
    "log": log, "log2": lambda c: log(c, "2"), "log10": lambda c: log(c, "10"), "log1p": lambda c: log(c, "1p"),
    "sqrt": lambda c: F.when(c >= 0, F.sqrt(c)).when(c.isNotNull(), F.lit(NAN)), "cbrt": F.cbrt, "square": lambda c: c * c,
    "absolute": F.abs, "fabs": lambda c: F.abs(_d(c)), "sign": F.signum, "rint": F.rint, "floor": F.floor, "ceil": F.ceil,
    "isnan": F.isnan, "isinf": lambda c: F.abs(_d(c)) == INF, "isfinite": lambda c: ~F.isnan(c) & (F.abs(_d(c)) != INF),
    "isneginf": lambda c: _d(c) == -INF, "isposinf": lambda c: _d(c) == INF, "logical_not": lambda c: (c == 0).cast("double"),
}

BINARY = {
    "add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": divide,
    "arctan2": F.atan2, "power": F.pow,
    "fmod": lambda a, b: F.when(b != 0, _d(a) % _d(b)).otherwise(F.lit(NAN)),
    "remainder": lambda a, b: F.when(b != 0, _d(a) - _d(b) * F.rint(_d(a) / _d(b))).otherwise(F.lit(NAN)),
    "heaviside": lambda x, h0: F.when(x > 0, F.lit(1.0)).when(x < 0, F.lit(0.0)).otherwise(_d(h0)),
    "logical_and": lambda a, b: ((a != 0) & (b != 0)).cast("double"), "logical_or": lambda a, b: ((a != 0) | (b != 0)).cast("double"),
    "logical_xor": lambda a, b: ((a != 0) != (b != 0)).cast("double"),
    "greater": lambda a, b: a > b, "less": lambda a, b: a < b, "equal": lambda a, b: a == b, "not_equal": lambda a, b: a != b,
    "greater_equal": lambda a, b: a >= b, "less_equal": lambda a, b: a <= b,
}


def around(c: Column, decimals: int = 0) -> Column:
    """Half to even after scaling."""
    scale = F.lit(10.0**decimals)
    return F.rint(_d(c) * scale) / scale


def modf(c: Column) -> tuple[Column, Column]:
    """Fraction and integer part, both with the sign of the number."""
    whole = F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)).cast("double")
    return _d(c) - whole, whole


def divmod_(a: Column, b: Column) -> tuple[Column, Column]:
    """Floor quotient and the remainder that goes with it."""
    q = F.floor(_d(a) / F.nullif(_d(b), F.lit(0.0))).cast("double")
    return q, _d(a) - q * _d(b)


def clip(c: Column, low: float, high: float) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.least(_d(c), F.lit(high)), F.lit(low)))


def isclose(a: Column, b: Column, atol: float = 1e-8, rtol: float = 1e-5) -> Column:
    return (F.abs(a - b) <= atol + rtol * F.abs(b)) | (a == b)


def select(conditions: list[Column], choices: list[Column], default: float = 0.0) -> Column:
    """The choice of the first true condition."""
    out = F.when(conditions[0], choices[0])
    for c, x in zip(conditions[1:], choices[1:], strict=True):
        out = out.when(c, x)
    return out.otherwise(F.lit(default))


def logsumexp(values: Column) -> Column:
    """Of an array, about its maximum."""
    top = F.array_max(values)
    return top + F.ln(F.aggregate(values, F.lit(0.0), lambda a, x: a + F.exp(x - top)))


def softmax(values: Column) -> Column:
    lse = logsumexp(values)
    return F.transform(values, lambda x: F.exp(x - lse))


def expit(c: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c))


def logit(c: Column) -> Column:
    return log(divide(c, F.lit(1.0) - c))
