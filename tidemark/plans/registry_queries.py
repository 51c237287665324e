"""The registry's specifications, and selections of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.catalog import register
from tidemark.operators import registry as G
from tidemark.operators.features import catalogue


def _values(rows) -> str:
    return "VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else repr(x) for x in r) + ")" for r in rows)


def _registry_sql() -> str:
    """The same rules in SQL, from the fixed values."""
    concepts = [(f, c, G.LEAST_WINDOW.get(c, 1), int(c in G.BETA_CONCEPTS)) for f, c in catalogue()]
    scales = [(f, x) for f, xs in G.SCALES.items() for x in xs]
    return f"""c(family, concept, least, beta) AS ({_values(concepts)}), own(family, label) AS ({_values(scales)}), pairs(fast, slow) AS ({_values(G.FAST_SLOW)}), grids(grid) AS ({_values([(g,) for g in G.GRIDS])}), kinds(representation) AS ({_values([(G.RAW,), (G.OWN_PERCENTILE,), (G.OWN_ZSCORE,)])}),
labels AS (SELECT c.*, label, label AS span, false AS skip FROM c JOIN own USING (family) WHERE NOT starts_with(concept, 'return_skip_recent_')
  UNION ALL SELECT c.*, fast || '_' || slow, slow, false FROM c, pairs WHERE family = 'multispeed'
  UNION ALL SELECT c.*, regexp_extract(concept, '(\\d+d)_ex', 1), regexp_extract(concept, '(\\d+d)_ex', 1), true FROM c WHERE starts_with(concept, 'return_skip_recent_')),
kinded AS (SELECT *, CASE WHEN span = 'session' THEN 'session' WHEN span = 'context' THEN 'context' WHEN ends_with(span, 'm') THEN 'minutes' ELSE 'sessions' END AS kind,
  CASE WHEN span IN ('session', 'context') THEN CASE WHEN family = 'multispeed' THEN 390 END ELSE CAST(regexp_extract(span, '\\d+') AS INTEGER) END AS value FROM labels),
specs AS (SELECT concept || '__' || label || '__' || representation || '__' || grid AS feature_id, concept, family, label AS scale, kind, value, representation, grid,
  CAST(greatest(CASE WHEN skip THEN value + 1 ELSE 5 END, CASE WHEN kind = 'sessions' THEN value ELSE 1 END) + CASE WHEN representation = 'raw' THEN 0 ELSE 252 END + CASE WHEN family = 'same_time' THEN 20 ELSE 0 END + CASE WHEN beta = 1 THEN CASE WHEN starts_with(grid, 'intraday') THEN 20 ELSE 63 END ELSE 0 END AS INTEGER) AS history
  FROM kinded, grids, kinds
  WHERE (representation = 'raw' OR skip OR representation = 'own_history_percentile' AND family IN ('returns', 'volatility', 'volume'))
    AND (grid = 'daily_close' OR NOT skip AND family <> 'ranks' AND NOT (family = 'market' AND (starts_with(concept, 'market_breadth') OR starts_with(concept, 'breadth_') OR starts_with(concept, 'cross_sectional_') OR concept IN ('average_pairwise_correlation', 'beta_dispersion'))))
    AND (family <> 'session' OR grid IN ('daily_close', 'preclose_1555')) AND (family <> 'same_time' OR grid IN ('intraday_5m', 'intraday_1m'))
    AND CASE kind WHEN 'minutes' THEN starts_with(grid, 'intraday') AND value >= least WHEN 'sessions' THEN NOT starts_with(grid, 'intraday') AND value >= least WHEN 'session' THEN grid <> 'daily_close' ELSE true END)"""


@register("registry_features", f"WITH {_registry_sql()} SELECT * FROM specs")
def registry_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K compilation, K representations: every specification with its id and the sessions that it needs."""
    return G.table(spark, G.compile_specs(catalogue()))


_ANCHOR = "CASE WHEN starts_with(grid, 'intraday') THEN 'minutes' ELSE 'sessions' END AS anchor_kind, CASE WHEN starts_with(grid, 'intraday') THEN 30 ELSE 20 END AS anchor"


@register("registry_canonical", f"WITH {_registry_sql()}, a AS (SELECT *, {_ANCHOR} FROM specs) SELECT feature_id, concept, grid FROM a QUALIFY row_number() OVER (PARTITION BY concept, grid ORDER BY representation <> 'raw', kind <> anchor_kind, abs(ln(1 + coalesce(value, 100 * anchor)) - ln(1 + anchor)), history, feature_id) = 1")
def registry_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One feature for each concept and grid."""
    return G.table(spark, G.canonical(G.compile_specs(catalogue()))).select("feature_id", "concept", "grid")


@register("registry_scope", f"WITH {_registry_sql()} SELECT feature_id, history FROM specs WHERE concept IN ('simple_return', 'realized_vol', 'relative_volume') AND scale IN ('30m', '20d') AND representation = 'raw'")
def registry_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A research scope by concepts, scales and representations; unknown names are errors."""
    specs = G.select(G.compile_specs(catalogue()), concepts=["simple_return", "realized_vol", "relative_volume"], scale=["30m", "20d"], representation=["raw"])
    return G.table(spark, specs).select("feature_id", "history")


_LABELS = {"intraday": ["1m", "5m", "15m", "30m", "60m", "EOD"], "daily": ["1d", "2d", "5d", "10d", "20d"]}
_BASES = ["raw", "benchmark_adjusted", "beta_residual"]


@register("registry_targets", f"WITH g(grid) AS ({_values([(g,) for g in G.GRIDS])}), l(kind, label) AS ({_values([(k, x) for k, xs in _LABELS.items() for x in xs] + [('overnight', 'overnight')])}), b(basis) AS ({_values([(x,) for x in _BASES])}) SELECT 'target_' || lower(label) || '__' || basis || '__' || grid AS target_id, label, basis, grid FROM g, l, b WHERE kind = CASE WHEN starts_with(grid, 'intraday') THEN 'intraday' WHEN grid = 'daily_close' THEN 'daily' ELSE 'overnight' END")
def registry_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target ids of every grid, label and basis."""
    return spark.createDataFrame(G.target_ids(_LABELS, _BASES), "target_id string, label string, basis string, grid string")


@register("registry_variants", f"WITH {_registry_sql()}, of(feature_id, side) AS (VALUES ('simple_return__20d__raw__daily_close', 1), ('realized_vol__20d__raw__daily_close', 2)), o AS (SELECT s.*, side FROM specs s JOIN of USING (feature_id)), n AS (SELECT o.side, o.feature_id AS parent, s.feature_id FROM o JOIN specs s ON s.concept = o.concept AND s.grid = o.grid QUALIFY row_number() OVER (PARTITION BY o.side ORDER BY s.feature_id <> o.feature_id, s.representation <> 'raw', abs(s.history - o.history), s.feature_id) <= 4) SELECT DISTINCT least(x.feature_id, y.feature_id) AS a, greatest(x.feature_id, y.feature_id) AS b FROM n x, n y WHERE x.side = 1 AND y.side = 2 AND NOT (x.feature_id = x.parent AND y.feature_id = y.parent)")
def registry_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of nearest variants around a stable pair."""
    specs = G.compile_specs(catalogue())
    a, b = G.select(specs, ids=["simple_return__20d__raw__daily_close"])[0], G.select(specs, ids=["realized_vol__20d__raw__daily_close"])[0]
    return spark.createDataFrame(G.variant_pairs(specs, a, b), "a string, b string")
