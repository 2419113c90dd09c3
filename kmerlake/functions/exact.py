"""Exact tests on 2x2 tables as Column expressions.

The hypergeometric probability uses the saddle-point form of C. Loader, "Fast and accurate
computation of binomial probabilities" (2000): no large log-factorials are subtracted, so it
stays accurate for class sizes of 1e9. Tails are summed outwards from their largest term
over a stretch bounded by Bernstein's inequality (what lies beyond is below 1e-20 of the sum),
so the work grows with the standard deviation and not with the number of genes.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_SMALL = 16
_CORRECTION = [0.0] + [math.lgamma(i + 1) - i * math.log(i) + i for i in range(1, _SMALL)]
TIE = 1.0 + 1e-7


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def bind(body: Callable[[Column], Column], **values: Column) -> Column:
    """``let`` for several named values: ``body`` gets a struct of doubles."""
    return let(F.struct(*[v.cast("double").alias(name) for name, v in values.items()]), body)


def stirling_tail(z: Column) -> Column:
    """ln Γ(z) − ((z−½)ln z − z + ½ ln 2π) for z ≥ 16."""
    s = z * z
    return (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - 1 / 1188 / s) / s) / s) / s) / z


def _correction(n: Column) -> Column:
    """ln n! − n ln n + n."""
    table = F.array(*[F.lit(v) for v in _CORRECTION])
    return F.when(n < _SMALL, F.element_at(table, n.cast("int") + 1)).otherwise(
        0.5 * F.log(2 * math.pi * n) + stirling_tail(n))


def _deviance(x: Column, mean: Column) -> Column:
    """x ln(x/mean) + mean − x."""
    rel = (x - mean) / mean
    return F.when(x <= 0, mean).otherwise(mean * ((1 + rel) * F.log1p(rel) - rel))


def _signed_sum(terms: list[tuple[int, Column, Column]], value: Callable[[Column, Column], Column]) -> Column:
    """Sum of sign·value(x, y); a loop, so that ``value`` stands in the plan only once."""
    rows = F.array(*[
        F.struct(F.lit(float(sign)).alias("s"), x.alias("x"), y.alias("y")) for sign, x, y in terms])
    return F.aggregate(rows, F.lit(0.0), lambda acc, r: acc + r["s"] * value(r["x"], r["y"]))


def hypergeom_logpmf(x: Column, pos: Column, neg: Column, drawn: Column) -> Column:
    """ln P(X = x), X = positives among ``drawn`` out of ``pos`` + ``neg``; x within the support.

    The quotient of three binomial probabilities with success rate drawn/total.
    """

    def body(v: Column) -> Column:
        x, pos, neg, drawn, total = (v[c] for c in ("x", "pos", "neg", "drawn", "total"))
        p, q = drawn / total, (total - drawn) / total
        parts = [(1, x, pos), (1, drawn - x, neg), (-1, drawn, total)]
        corrections = [
            entry for sign, k, n in parts for entry in ((sign, n, n), (-sign, k, n), (-sign, n - k, n))]
        deviances = [
            entry for sign, k, n in parts for entry in ((-sign, k, n * p), (-sign, n - k, n * q))]
        return F.when((drawn <= 0) | (drawn >= total), F.lit(0.0)).otherwise(
            _signed_sum(corrections, lambda n, _: _correction(n)) + _signed_sum(deviances, _deviance))

    return bind(body, x=x, pos=pos, neg=neg, drawn=drawn, total=pos + neg)


def _mode(pos: Column, neg: Column, drawn: Column) -> Column:
    return F.floor((drawn + 1.0) * (pos + 1.0) / (pos + neg + 2.0))


def _reach(pos: Column, neg: Column, drawn: Column) -> Column:
    """Distance from the bulk beyond which the remaining tail is negligible."""
    total = pos + neg
    variance = drawn * (pos / total) * (neg / total) * ((total - drawn) / F.greatest(total - 1.0, F.lit(1.0)))
    return F.ceil(16.0 + F.sqrt(256.0 + 100.0 * F.greatest(variance, F.lit(0.0))))


def _ln_sum_up(start: Column, stop: Column, pos: Column, neg: Column, drawn: Column) -> Column:
    """ln P(start ≤ X ≤ stop) by the term ratio; both ends inside the support.

    Terms are taken against the first one, so that no probability is too small to be told apart.
    """
    state = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum"))

    def step(acc: Column, x: Column) -> Column:
        ratio = (pos - x) * (drawn - x) / ((x + 1.0) * (neg - drawn + x + 1.0))
        return F.struct((acc["term"] * ratio).alias("term"), (acc["sum"] + acc["term"]).alias("sum"))

    against_first = F.aggregate(F.sequence(start.cast("long"), stop.cast("long")), state, step)["sum"]
    return hypergeom_logpmf(start, pos, neg, drawn) + F.log(against_first)


def _ln_upper_tail(at: Column, pos: Column, neg: Column, drawn: Column) -> Column:
    """ln P(X ≥ at)."""

    def body(v: Column) -> Column:
        return bind(
            lambda e: F.least(F.lit(0.0), _ln_sum_up(e["start"], e["stop"], v["pos"], v["neg"], v["drawn"])),
            start=F.greatest(v["at"], v["drawn"] - v["neg"], v["mode"] - v["reach"], F.lit(0.0)),
            stop=F.least(v["pos"], v["drawn"], F.greatest(v["at"], v["mode"]) + v["reach"]),
        )

    return bind(body, at=at, pos=pos, neg=neg, drawn=drawn,
                mode=_mode(pos, neg, drawn), reach=_reach(pos, neg, drawn))


def ln_fisher_greater(pos_count: Column, n_pos: Column, neg_count: Column, n_neg: Column) -> Column:
    """ln of the one-sided p-value of [[pos_count, n_pos−pos_count], [neg_count, n_neg−neg_count]].

    A count above its class size is not a table: the p-value is then 1.
    """
    return bind(
        lambda t: F.when((t["a"] > t["m"]) | (t["b"] > t["n"]), F.lit(0.0))
        .when((t["a"] <= 0) | (t["b"] >= t["n"]), F.lit(0.0))
        .otherwise(_ln_upper_tail(t["a"], t["m"], t["n"], t["a"] + t["b"])),
        a=pos_count, m=n_pos, b=neg_count, n=n_neg,
    )


def fisher_greater(pos_count: Column, n_pos: Column, neg_count: Column, n_neg: Column) -> Column:
    """One-sided p-value; it is 0 below 5e-324, where only ``ln_fisher_greater`` tells tables apart."""
    return F.exp(ln_fisher_greater(pos_count, n_pos, neg_count, n_neg))


def ln_fisher_balanced(pos_count: Column, neg_count: Column, n_rows: Column) -> Column:
    """One-sided test with both class sizes taken as half of the data rows."""
    half = F.floor(n_rows / 2)
    return ln_fisher_greater(pos_count, half, neg_count, half)


def fisher_balanced(pos_count: Column, neg_count: Column, n_rows: Column) -> Column:
    return F.exp(ln_fisher_balanced(pos_count, neg_count, n_rows))


def _ln_add(a: Column, b: Column) -> Column:
    """ln(exp(a) + exp(b))."""
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def odds_ratio(a: Column, n_pos: Column, b: Column, n_neg: Column) -> Column:
    """Sample odds ratio; infinite when the denominator is 0, NaN when a margin is 0."""
    return bind(
        lambda t: F.when(
            (t["a"] + t["b"] == 0) | (t["c"] + t["d"] == 0) | (t["a"] + t["c"] == 0) | (t["b"] + t["d"] == 0),
            F.lit(float("nan")))
        .when((t["b"] == 0) | (t["c"] == 0), F.lit(float("inf")))
        .otherwise(t["a"] * t["d"] / (t["b"] * t["c"])),
        a=a, b=b, c=n_pos - a, d=n_neg - b,
    )


def fisher_two_sided(a: Column, n_pos: Column, b: Column, n_neg: Column) -> Column:
    return F.exp(ln_fisher_two_sided(a, n_pos, b, n_neg))


def ln_fisher_two_sided(a: Column, n_pos: Column, b: Column, n_neg: Column) -> Column:
    """ln of the two-sided p-value: all tables no more likely than the observed one (tolerance 1e-7)."""

    def oriented(t: Column) -> Column:
        # Mirror the classes when needed, so that the observed count lies above the mode.
        pick = lambda x, y: F.when(t["above"], t[x]).otherwise(t[y])
        return bind(
            tails, a=pick("a", "b"), m=pick("m", "n"), n=pick("n", "m"),
            drawn=t["drawn"], low=F.greatest(F.lit(0.0), t["drawn"] - pick("n", "m")),
            mode=_mode(pick("m", "n"), pick("n", "m"), t["drawn"]),
            limit=hypergeom_logpmf(t["a"], t["m"], t["n"], t["drawn"]) + math.log(TIE),
        )

    def tails(t: Column) -> Column:
        # Last count below the mode that is no more likely than the observed one: bisection,
        # where ``lo`` always is that or lies below the support and ``hi`` never does.
        def halve(s: Column, _: Column) -> Column:
            return bind(
                lambda v: F.struct(
                    F.when(v["logp"] <= t["limit"], v["mid"]).otherwise(s["lo"]).alias("lo"),
                    F.when(v["logp"] <= t["limit"], s["hi"]).otherwise(v["mid"]).alias("hi")),
                mid=F.floor((s["lo"] + s["hi"]) / 2),
                logp=hypergeom_logpmf(
                    F.greatest(F.floor((s["lo"] + s["hi"]) / 2), t["low"]), t["m"], t["n"], t["drawn"]),
            )

        steps = F.sequence(F.lit(1), F.ceil(F.log2(t["mode"] - t["low"] + 2.0)).cast("int") + 1)
        found = F.aggregate(
            steps, F.struct((t["low"] - 1.0).alias("lo"), t["mode"].alias("hi")), halve)["lo"]
        # P(X ≤ x) is the upper tail of the mirrored variable (draws from the other class).
        both = lambda near: let(found, lambda x: F.when(x < t["low"], near).otherwise(
            _ln_add(near, _ln_upper_tail(t["drawn"] - x, t["n"], t["m"], t["drawn"]))))
        at_mode = hypergeom_logpmf(t["mode"], t["m"], t["n"], t["drawn"])
        return F.when(t["limit"] >= at_mode, F.lit(0.0)).otherwise(
            F.least(F.lit(0.0), let(_ln_upper_tail(t["a"], t["m"], t["n"], t["drawn"]), both)))

    def table(t: Column) -> Column:
        drawn = t["a"] + t["b"]
        return F.when(
            (t["a"] > t["m"]) | (t["b"] > t["n"]) | (t["a"] < 0) | (t["b"] < 0)
            | (t["m"] == 0) | (t["n"] == 0) | (drawn == 0) | (drawn == t["m"] + t["n"]), F.lit(0.0),
        ).otherwise(let(F.struct(
            t["a"].alias("a"), t["m"].alias("m"), t["b"].alias("b"), t["n"].alias("n"), drawn.alias("drawn"),
            (t["a"] > _mode(t["m"], t["n"], drawn)).alias("above")), oriented))

    return bind(table, a=a, m=n_pos, b=b, n=n_neg)
