"""The registry: concepts times scales, representations and decision grids, compiled to specifications with ids of their own.

What is compiled is small (thousands of rows) and fixed by rules, so it is made on the driver; selections of it are
DataFrames like any other table.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterable
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession

# Scales of the families, fast and slow scales that go together, decision grids, representations.
INTRADAY = ("1m", "2m", "5m", "10m", "15m", "30m", "60m", "120m", "240m", "session")
DAILY = ("1d", "2d", "3d", "5d", "10d", "20d", "30d", "40d", "63d", "126d", "252d")
MIDDLE = ("30m", "60m", "120m", "240m", "session", "1d", "2d", "3d", "5d", "10d", "20d", "30d", "40d", "63d")
SCALES = {
    "returns": INTRADAY + DAILY, "path": MIDDLE, "consistency": MIDDLE, "ranks": DAILY, "location": MIDDLE, "candles": INTRADAY[:-1] + ("1d",), "moving_average": INTRADAY[4:9] + DAILY, "volatility": INTRADAY[2:] + DAILY[:-1], "distribution": MIDDLE,
    "serial": INTRADAY[6:] + ("5d", "10d", "20d", "40d", "63d"), "volume": INTRADAY[2:] + DAILY[:9], "liquidity": MIDDLE, "price_volume": INTRADAY[2:] + DAILY[:8], "session": ("1d", "2d", "5d", "10d", "20d"), "same_time": ("5m", "30m"),
    "market": ("5m", "15m", "30m", "60m", "120m", "240m", "session", "1d", "2d", "5d", "10d", "20d", "40d", "63d", "126d"), "calendar": ("context",),
}
FAST_SLOW = (
    ("1m", "5m"), ("2m", "10m"), ("5m", "30m"), ("15m", "60m"), ("30m", "120m"), ("120m", "session"), ("1d", "5d"), ("2d", "10d"), ("5d", "20d"), ("10d", "40d"), ("20d", "63d"), ("40d", "126d"), ("63d", "252d"),
)
GRIDS = ("intraday_5m", "daily_close", "preclose_1555", "intraday_1m")
FAMILY_GRIDS = {"ranks": GRIDS[1:2], "session": GRIDS[1:3], "same_time": (GRIDS[0], GRIDS[3])}
RAW, OWN_PERCENTILE, OWN_ZSCORE = "raw", "own_history_percentile", "own_history_zscore"
REPRESENTED = ("returns", "volatility", "volume")
# Least window of concepts that need more than one observation; concepts that only a whole cross-section has.
LEAST_WINDOW = {
    "return_t_stat": 2, "return_rank_std": 2, "gap_vs_prior_vol": 2, "vol_acceleration": 4, "vol_compression_ratio": 4, "downside_vol_acceleration": 4, "upside_vol_acceleration": 4, "return_autocorr_lag1": 3, "return_autocorr_lag2": 4, "return_autocorr_lag3": 5, "sign_autocorr_lag1": 3, "abs_return_autocorr_lag1": 3,
    "variance_ratio_2": 4, "variance_ratio_5": 7, "permutation_entropy": 6, "hurst_exponent": 32, "market_correlation": 3, "market_lead_response": 3, "stock_lead_market_response": 3, "average_pairwise_correlation": 3, "breadth_momentum": 5,
}
BETA_CONCEPTS = ("benchmark_excess_return", "beta_residual_return", "idiosyncratic_vol", "market_beta", "downside_beta", "upside_beta", "beta_change", "cross_sectional_residual_dispersion", "beta_dispersion")
#: Sessions that a history, a beta (by grid) and a clock's history need; least observations; minutes of a session.
OWN_HISTORY, BETA_INTRADAY, BETA_DAILY, CLOCK_HISTORY, LEAST, SESSION_MINUTES = 252, 20, 63, 20, 5, 390
#: The scales that stand for a concept where one is wanted, by grid.
ANCHORS = {"intraday_5m": "30m", "intraday_1m": "30m", "daily_close": "20d", "preclose_1555": "20d"}


@dataclass(frozen=True)
class Scale:
    """A span: minutes, sessions, the session so far, or none (context)."""

    label: str
    kind: str
    value: int | None


def scale(label: str) -> Scale:
    if label in ("session", "EOD"):
        return Scale(label, "session", None)
    if label in ("context", "overnight"):
        return Scale(label, "context", None)
    found = re.fullmatch(r"([1-9]\d*)([md])", label)
    if not found:
        raise ValueError(f"{label!r} is no scale")
    return Scale(label, {"m": "minutes", "d": "sessions"}[found[2]], int(found[1]))


@dataclass(frozen=True)
class Spec:
    feature_id: str
    concept: str
    family: str
    scale: str
    kind: str
    value: int | None
    representation: str
    grid: str
    history: int

    @property
    def definition(self) -> str:
        """A hash of everything that defines the feature."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:24]


def cross_sectional(concept: str) -> bool:
    return concept.startswith(("market_breadth", "breadth_", "cross_sectional_")) or concept in ("average_pairwise_correlation", "beta_dispersion")


def _scales(concept: str, family: str) -> list[Scale]:
    if family == "multispeed":
        return [replace(s, label=f"{fast}_{slow}", value=s.value or SESSION_MINUTES) for fast, slow in FAST_SLOW for s in [scale(slow)]]
    skip = re.fullmatch(r"return_skip_recent_(\d+)d_ex_\d+d", concept)
    return [scale(f"{skip[1]}d")] if skip else [scale(x) for x in SCALES[family]]


def _fits(s: Scale, grid: str, concept: str) -> bool:
    """Minutes go with intraday grids, sessions with the others; a session so far has no place at the close; short windows fall out."""
    intraday = grid.startswith("intraday")
    if s.kind == "minutes" and not intraday or s.kind == "sessions" and intraday or s.kind == "session" and grid == "daily_close":
        return False
    return s.kind not in ("minutes", "sessions") or s.value >= LEAST_WINDOW.get(concept, 1)


def compile_specs(concepts: Iterable[tuple[str, str]], scales: Iterable[str] | None = None, grids: Iterable[str] = GRIDS) -> list[Spec]:
    """Specifications of the (family, concept) pairs; scales are those that are configured (all, if none are given). Equal ids are an error."""
    wanted, grids, out = None if scales is None else {"context", *scales}, tuple(grids), []
    for family, concept in concepts:
        skip = concept.startswith("return_skip_recent_")
        own = (RAW, OWN_ZSCORE, OWN_PERCENTILE) if skip else (RAW, OWN_PERCENTILE) if family in REPRESENTED else (RAW,)
        on = ("daily_close",) if skip or family == "market" and cross_sectional(concept) else FAMILY_GRIDS.get(family, GRIDS)
        for s in _scales(concept, family):
            if wanted is not None and not wanted.issuperset(s.label.split("_")):
                continue
            for representation in own:
                for grid in on:
                    if grid not in grids or not _fits(s, grid, concept):
                        continue
                    least = int(re.findall(r"\d+", concept)[0]) + 1 if skip else LEAST
                    history = max(least, s.value if s.kind == "sessions" else 1)
                    history += OWN_HISTORY * (representation != RAW) + CLOCK_HISTORY * (family == "same_time")
                    if concept in BETA_CONCEPTS:
                        history += BETA_INTRADAY if grid.startswith("intraday") else BETA_DAILY
                    out.append(Spec(f"{concept}__{s.label}__{representation}__{grid}", concept, family, s.label, s.kind, s.value, representation, grid, history))
    ids = [x.feature_id for x in out]
    if len(ids) != len(set(ids)):
        raise ValueError(f"ids that stand twice: {sorted({x for x in ids if ids.count(x) > 1})[:5]}")
    return out


def target_ids(labels: dict[str, Iterable[str]], bases: Iterable[str], grids: Iterable[str] = GRIDS) -> list[tuple[str, str, str, str]]:
    """(target_id, label, basis, grid). labels: of the intraday grids, of the daily one; the grid before the close has the overnight target alone."""
    out, bases = [], list(bases)
    for grid in grids:
        own = labels["intraday"] if grid.startswith("intraday") else labels["daily"] if grid == "daily_close" else ["overnight"]
        out += [(f"target_{label.lower()}__{basis}__{grid}", label, basis, grid) for label in own for basis in bases]
    if len({x[0] for x in out}) != len(out):
        raise ValueError("target ids that stand twice")
    return out


def canonical(specs: Iterable[Spec], anchors: dict[str, str] | None = None) -> list[Spec]:
    """One feature of each concept and grid: raw before others, the anchor's kind of scale, the nearest to the anchor by logarithm, the shortest history, the id."""
    anchors, best = anchors or ANCHORS, {}
    for x in specs:
        a = scale(anchors.get(x.grid, "20d"))
        value = x.value if x.value is not None else 100 * a.value
        key = (x.representation != RAW, x.kind != a.kind, abs(math.log1p(value) - math.log1p(a.value)), x.history, x.feature_id)
        if (x.concept, x.grid) not in best or key < best[x.concept, x.grid][0]:
            best[x.concept, x.grid] = (key, x)
    return [x for _, x in best.values()]


def select(specs: list[Spec], ids: Iterable[str] = (), concepts: Iterable[str] = (), **only: Iterable[str]) -> list[Spec]:
    """Specifications by id or concept, then only those of the given family, scale, representation, grid. Unknown ids and concepts are errors, and so is an empty selection."""
    ids, concepts = set(ids), set(concepts)
    for given, known, what in ((ids, {x.feature_id for x in specs}, "ids"), (concepts, {x.concept for x in specs}, "concepts")):
        if given - known:
            raise ValueError(f"unknown {what}: {sorted(given - known)}")
    out = [x for x in specs if not (ids or concepts) or x.feature_id in ids or x.concept in concepts]
    for name, values in only.items():
        out = [x for x in out if getattr(x, name) in set(values)]
    if not out:
        raise ValueError("the selection holds nothing")
    return out


def variants(specs: list[Spec], of: Spec, most: int = 3) -> list[Spec]:
    """A feature and its nearest variants: of its concept and grid, raw first, then by the distance of their histories."""
    own = [x for x in specs if x.concept == of.concept and x.grid == of.grid]
    return sorted(own, key=lambda x: (x.feature_id != of.feature_id, x.representation != RAW, abs(x.history - of.history), x.feature_id))[: most + 1]


def variant_pairs(specs: list[Spec], a: Spec, b: Spec, most: int = 3) -> list[tuple[str, str]]:
    """The pairs around a stable pair, each in the order of its ids, without the pair itself."""
    near = [(x.feature_id, y.feature_id) for x in variants(specs, a, most) for y in variants(specs, b, most)]
    return sorted({tuple(sorted(p)) for p in near if p != (a.feature_id, b.feature_id)})


def with_contexts(structures: Iterable[tuple[str, ...]], contexts: Iterable[str]) -> list[tuple[str, tuple[str, ...]]]:
    """(interaction id, features) of every structure with every context feature."""
    contexts = list(contexts)
    return [(hashlib.sha256("\0".join([*s, c]).encode()).hexdigest()[:24], (*s, c)) for s in structures for c in contexts]


def table(spark: SparkSession, specs: Iterable[Spec]) -> DataFrame:
    rows = [(*(asdict(x).values()),) for x in specs]
    return spark.createDataFrame(rows, "feature_id string, concept string, family string, scale string, kind string, value int, representation string, grid string, history int")


#: Implementations by pack and name.
_PACKS: dict[str, dict[str, object]] = {}


def implementation(pack: str, name: str):
    """Decorator: a feature's or target's implementation, a function from a DataFrame to a Column, under a name of a pack."""

    def keep(f):
        own = _PACKS.setdefault(pack, {})
        if name in own:
            raise ValueError(f"{pack} has {name} already")
        own[name] = f
        return f

    return keep


def load_pack(manifest: dict) -> dict[str, object]:
    """The implementations that a manifest {name, implementations: {name: "module:function"}} lists, imported and registered."""
    import importlib

    for name, where in manifest["implementations"].items():
        module, _, function = where.partition(":")
        found = getattr(importlib.import_module(module), function, None)
        if not callable(found):
            raise ValueError(f"{where} is no function")
        implementation(manifest["name"], name)(found)
    return _PACKS[manifest["name"]]


def compute(df: DataFrame, pack: str, names: Iterable[str], dtype: str = "double") -> DataFrame:
    """df with a column of each named implementation; a column of another type is an error, so that no feature changes the table's shape."""
    own = _PACKS.get(pack, {})
    missing = [n for n in names if n not in own]
    if missing:
        raise ValueError(f"{pack} has no {missing}")
    out = df.withColumns({n: own[n](df) for n in names})
    wrong = [n for n in names if out.schema[n].dataType.simpleString() != dtype]
    if wrong:
        raise TypeError(f"not {dtype}: {wrong}")
    return out
