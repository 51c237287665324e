"""SQL expression text for window formulas, in the dialect of Spark or of the checking engine.

A feature is written once as a formula; this renders it. Only what differs between dialects is here: percentiles,
finiteness, lists. A formula may use columns of earlier stages, so that windows never nest.
"""

from __future__ import annotations

import math
from dataclasses import dataclass


def required(n: int, least: int = 1) -> int:
    """Observations that a window of n rows needs."""
    return min(n, max(least, 5, math.ceil(0.6 * n)))


@dataclass(frozen=True)
class Sql:
    spark: bool = True
    key: str = "security_id"
    order: str = "session_date"

    # windows
    def over(self, n: int | None, lag: int = 0, key: str | None = None, order: str | None = None) -> str:
        lo = "UNBOUNDED" if n is None else str(n - 1 + lag)
        hi = f"{lag} PRECEDING" if lag else "CURRENT ROW"
        return f"OVER (PARTITION BY {key or self.key} ORDER BY {order or self.order} ROWS BETWEEN {lo} PRECEDING AND {hi})"

    def lag(self, x: str, k: int = 1, key: str | None = None) -> str:
        return f"lag({x}, {k}) OVER (PARTITION BY {key or self.key} ORDER BY {self.order})"

    def roll(self, fn: str, x: str, n: int, lag: int = 0, least: int | None = None, key: str | None = None) -> str:
        """fn over the window where enough observations stand in it. fn may hold a {x} and an {over}."""
        w, need = self.over(n, lag, key), required(n) if least is None else least
        body = fn.format(x=x, over=w) if "{x}" in fn else f"{fn}({x}) {w}"
        return f"CASE WHEN count({x}) {w} >= {need} THEN {body} END"

    def pair(self, fn: str, y: str, x: str, n: int, lag: int = 0, least: int | None = None) -> str:
        """A two-column aggregate over the window's complete rows."""
        w, need = self.over(n, lag), required(n) if least is None else least
        both = f"CASE WHEN ({y}) IS NOT NULL AND ({x}) IS NOT NULL THEN 1 END"
        if self.spark and fn == "corr":  # corr() divides by zero where a side is constant
            known = lambda c: f"CASE WHEN ({both}) = 1 THEN {c} END"
            return f"CASE WHEN count({both}) {w} >= {need} THEN (covar_pop({y}, {x}) {w}) / nullif((stddev_pop({known(y)}) {w}) * (stddev_pop({known(x)}) {w}), 0e0) END"
        return self.finite(f"CASE WHEN count({both}) {w} >= {need} THEN {fn}({y}, {x}) {w} END")

    def quantile(self, x: str, q: float, n: int, lag: int = 0, least: int | None = None) -> str:
        fn = "percentile({x}, " + f"{q}) {{over}}" if self.spark else "quantile_cont({x}, " + f"{q}) {{over}}"
        return self.roll(fn, x, n, lag, least)

    # scalars
    def div(self, a: str, b: str) -> str:
        return f"(({a}) / nullif({b}, 0e0))"

    def finite(self, x: str) -> str:
        return f"nullif(nullif(nullif({x}, double('NaN')), double('Infinity')), double('-Infinity'))" if self.spark else f"nullif(nullif(nullif({x}, 'NaN'::DOUBLE), 'Infinity'::DOUBLE), '-Infinity'::DOUBLE)"

    def low(self, x: str, bound: str) -> str:
        """x, or bound where x is below it; a missing x stays missing (greatest() would skip it)."""
        return f"(CASE WHEN ({x}) < {bound} THEN {bound} ELSE ({x}) END)"

    def high(self, x: str, bound: str) -> str:
        return f"(CASE WHEN ({x}) > {bound} THEN {bound} ELSE ({x}) END)"

    def ln(self, x: str) -> str:
        return f"ln(CASE WHEN ({x}) > 0 THEN {x} END)"

    def round(self, x: str, digits: int = 6) -> str:
        """Rounded to digits; values of a million or more (a small number in a denominator) to whole millions."""
        return f"CASE WHEN abs({x}) >= 1e6 THEN round(CAST({x} AS DOUBLE) / 1e6, 0) * 1e6 ELSE round(CAST({x} AS DOUBLE), {digits}) + 0e0 END"

    # lists: their elements are never null, since a list is used only where its window is full
    def listed(self, x: str, n: int, lag: int = 0) -> str:
        w = self.over(n, lag)
        fn = "collect_list" if self.spark else "list"
        return f"CASE WHEN count({x}) {w} >= {n} THEN {fn}({x}) {w} END"

    def each(self, items: str, body: str, var: str = "x", at: str = "i") -> str:
        """body over the elements (named var) and their places (written {at} in braces), from 1."""
        place = f"({at} + 1)" if self.spark else at
        body = body.replace("{" + at + "}", place)
        return f"transform({items}, ({var}, {at}) -> {body})" if self.spark else f"list_transform({items}, lambda {var}, {at}: {body})"

    def only(self, items: str, test: str) -> str:
        return f"filter({items}, x -> {test})" if self.spark else f"list_filter({items}, lambda x: {test})"

    def head(self, items: str, k: str) -> str:
        return f"slice({items}, 1, {k})" if self.spark else f"({items})[1:{k}]"

    def size(self, items: str) -> str:
        return f"CAST(size({items}) AS DOUBLE)" if self.spark else f"CAST(len({items}) AS DOUBLE)"

    def total(self, items: str) -> str:
        return f"aggregate({items}, 0e0, (a, x) -> a + x)" if self.spark else f"coalesce(list_sum({items}), 0e0)"

    def top(self, items: str) -> str:
        return f"array_max({items})" if self.spark else f"list_max({items})"

    def bottom(self, items: str) -> str:
        return f"array_min({items})" if self.spark else f"list_min({items})"

    def falling(self, items: str) -> str:
        return f"sort_array({items}, false)" if self.spark else f"list_reverse_sort({items})"

    def at(self, items: str, k: str) -> str:
        return f"element_at({items}, {k})" if self.spark else f"({items})[{k}]"


SPARK, CHECK = Sql(True), Sql(False)
