"""Welch's unequal-variance t-test as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from kmerlake.functions.exact import let, stirling_tail

_SERIES_STEPS = 400
_FRACTION_STEPS = 200
_SHIFT = 16


def _log_gamma_step(a: Column) -> Column:
    """ln Γ(a+½) − ln Γ(a), without subtracting two large numbers."""
    z = a + float(_SHIFT)
    far = z * F.log1p(0.5 / z) + 0.5 * F.log(z) - 0.5 + stirling_tail(z + 0.5) - stirling_tail(z)
    near = sum((F.log1p(0.5 / (a + float(i))) for i in range(1, _SHIFT)), F.log1p(0.5 / a))
    return far - near


def t_two_tailed(t: Column, df: Column) -> Column:
    """Two-tailed p-value of Student's t: I_x(df/2, 1/2) with x = df/(df+t²)."""

    def body(v: Column) -> Column:
        t2, a = v["t2"], v["a"]
        log_front = -a * F.log1p(t2 / (2 * a)) + _log_gamma_step(a) - 0.5 * math.log(math.pi)
        x = 2 * a / (2 * a + t2)
        y = t2 / (2 * a + t2)

        # Central part by its series of positive terms; good while t² is small.
        def term(s: Column, n: Column) -> Column:
            nxt = s["term"] * y * (a + 0.5 + n) / (n + 1.5)
            return F.struct(nxt.alias("term"), (s["sum"] + s["term"]).alias("sum"))

        series = F.aggregate(
            F.sequence(F.lit(0), F.lit(_SERIES_STEPS)),
            F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum")), term)["sum"]
        central = F.exp(log_front) * F.sqrt(y) * 2.0 * series

        # Tail by the continued fraction of the incomplete beta function (Lentz).
        def lentz(s: Column, m: Column) -> Column:
            even = m * (0.5 - m) * x / ((a + 2 * m - 1.0) * (a + 2 * m))
            odd = -(a + m) * (a + 0.5 + m) * x / ((a + 2 * m) * (a + 2 * m + 1.0))

            def half(state: Column, coef: Column) -> Column:
                return let(
                    F.struct((1.0 + coef / state["c"]).alias("c"), (1.0 / (1.0 + coef * state["d"])).alias("d")),
                    lambda n: F.struct(n["c"].alias("c"), n["d"].alias("d"), (state["h"] * n["c"] * n["d"]).alias("h")),
                )

            return let(half(s, even), lambda mid: half(mid, odd))

        first = 1.0 / (1.0 - (a + 0.5) * x / (a + 1.0))
        fraction = F.aggregate(
            F.sequence(F.lit(1), F.lit(_FRACTION_STEPS)),
            F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h")), lentz)["h"]
        # x^a (1-x)^(1/2) / (a B(a, 1/2)), with the factor x^a inside log_front.
        tail = F.exp(log_front) * F.sqrt(y) / a * fraction
        return F.when(t2 == 0, F.lit(1.0)).when(t2 < 9.0, F.greatest(F.lit(0.0), 1.0 - central)).otherwise(
            F.least(F.lit(1.0), tail))

    value = F.struct((t * t).alias("t2"), (df / 2.0).alias("a"))
    return F.when(t.isNull() | df.isNull(), F.lit(None).cast("double")).otherwise(let(value, body))


def welch(mean1: Column, var1: Column, n1: Column, mean2: Column, var2: Column, n2: Column) -> dict[str, Column]:
    """Columns ``t``, ``df`` from class means, sample variances and sizes; null below 2 values."""
    e1, e2 = var1 / n1, var2 / n2
    ok = (n1 >= 2) & (n2 >= 2) & (e1 + e2 > 0)
    t = F.when(ok, (mean1 - mean2) / F.sqrt(e1 + e2))
    df = F.when(ok, (e1 + e2) * (e1 + e2) / (e1 * e1 / (n1 - 1) + e2 * e2 / (n2 - 1)))
    return {"t": t, "df": df}
