"""Queries for the consensus of explanations (CO1-CO16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lucerna.functions.exprs import rnd
from lucerna.operators import consensus as CO
from lucerna.operators import explain as EX
from lucerna.plans.catalog import query
from lucerna.plans.fixtures import FEATURES
from lucerna.plans.oracle_views import R, with_views


def _r(df, *cols):
    return df.select(*[rnd(c).alias(c) if c in cols else F.col(c) for c in df.columns])


@query("co_load_rank", "CO1", with_views(
    "SELECT model, method, sample_id, feature, attribution, ranking FROM ranked", "ranked"))
def co_load_rank(v):
    return CO.with_ranking(v.attributions).select("model", "method", "sample_id", "feature",
                                                  "attribution", "ranking")


@query("co_average_mean", "CO2,CO8", with_views(
    f"SELECT model, feature, {R('avg(attribution)')} AS attribution FROM attributions GROUP BY 1, 2",
    "attributions"))
def co_average_mean(v):
    return _r(CO.average_mean(v.attributions), "attribution")


_MINMAX = """
s AS (SELECT model, min(attribution) AS mn, max(attribution) AS mx FROM attributions GROUP BY model),
x AS (SELECT a.model, a.feature,
             CASE WHEN mx - mn = 0 THEN 0.0 ELSE (attribution - mn) / (mx - mn) END AS x
      FROM attributions a JOIN s ON a.model = s.model)"""


@query("co_harmonic_mean", "CO3", with_views(
    f"SELECT * FROM (WITH {_MINMAX} SELECT model, feature, "
    f"{R('CASE WHEN min(x) = 0 THEN 0.0 ELSE count(*) / sum(1.0 / x) END')} AS attribution "
    f"FROM x GROUP BY 1, 2) q", "attributions"))
def co_harmonic_mean(v):
    return _r(CO.harmonic_mean(v.attributions), "attribution")


@query("co_geometric_mean", "CO4", with_views(
    f"SELECT * FROM (WITH {_MINMAX} SELECT model, feature, "
    f"{R('CASE WHEN min(x) = 0 THEN 0.0 ELSE exp(avg(ln(greatest(x, 1e-300)))) END')} AS attribution "
    f"FROM x GROUP BY 1, 2) q", "attributions"))
def co_geometric_mean(v):
    return _r(CO.geometric_mean(v.attributions), "attribution")


@query("co_voting", "CO5", with_views(
    "SELECT model, feature, CAST(sum(CASE WHEN ranking <= 10 THEN 1 ELSE 0 END) AS BIGINT) AS votes "
    "FROM ranked GROUP BY 1, 2", "ranked"))
def co_voting(v):
    return CO.voting(CO.with_ranking(v.attributions))


# 25 brands as features: ranks beyond the top ten and the cap at 11 both occur
_WIDE = """
w AS (SELECT 'LR' AS model, 'Shapley' AS method, sample_id, feature, attribution,
             CAST(row_number() OVER (PARTITION BY sample_id ORDER BY attribution DESC, feature) AS BIGINT) AS ranking
      FROM flag_brand_effects)"""


def _wide(v):
    f = v.flag_brand_effects
    return CO.with_ranking(f.select(F.lit("LR").alias("model"), F.lit("Shapley").alias("method"),
                                    "sample_id", "feature", "attribution"))


@query("co_voting_wide", "CO5", with_views(
    f"SELECT * FROM (WITH {_WIDE} SELECT model, feature, "
    "CAST(sum(CASE WHEN ranking <= 10 THEN 1 ELSE 0 END) AS BIGINT) AS votes FROM w GROUP BY 1, 2) q",
    "flag_brand_effects"))
def co_voting_wide(v):
    return CO.voting(_wide(v))


@query("co_weighted_capped_wide", "CO10", with_views(f"""
SELECT * FROM (WITH {_WIDE} SELECT w.model, w.method, w.sample_id, w.feature,
       {R('w.attribution * q.metric')} AS attribution, least(w.ranking, 11) AS ranking
FROM w JOIN model_quality q ON w.model = q.model) q""", "flag_brand_effects", "model_quality"))
def co_weighted_capped_wide(v):
    return _r(CO.weighted_capped(_wide(v), v.model_quality), "attribution")


@query("co_average_rank", "CO6", with_views(
    f"SELECT model, feature, {R('avg(ranking)')} AS ranking FROM ranked GROUP BY 1, 2", "ranked"))
def co_average_rank(v):
    return _r(CO.average_rank(CO.with_ranking(v.attributions)), "ranking")


@query("co_custom", "CO7,CO8", with_views(f"""
SELECT * FROM (WITH a AS (SELECT *, CASE WHEN sample_id IS NULL THEN 'g' ELSE 'l' END AS kind FROM attributions),
     s AS (SELECT model, kind, min(attribution) AS mn, max(attribution) AS mx FROM a GROUP BY 1, 2),
     nl AS (SELECT model, COUNT(*) AS nl FROM a WHERE kind = 'l' GROUP BY 1),
     x AS (SELECT a.*, CASE WHEN mx - mn = 0 THEN 0.0 ELSE (attribution - mn) / (mx - mn) END AS x
           FROM a JOIN s ON a.model = s.model AND a.kind = s.kind),
     y AS (SELECT x.model, x.feature, x.kind, x.probability, nl.nl,
                  x.x * CASE WHEN x.attribution < 0 THEN -1.0 ELSE 1.0 END
                      * (4.0 * q.metric * q.metric - 4.0 * q.metric + 1.0) AS s0
           FROM x JOIN model_quality q ON x.model = q.model LEFT JOIN nl ON x.model = nl.model)
SELECT model, feature, {R("sum(CASE WHEN kind = 'l' THEN s0 / nl * probability ELSE s0 END)")} AS attribution
FROM y GROUP BY 1, 2) q""", "attributions", "model_quality"))
def co_custom(v):
    return _r(CO.custom(v.attributions, v.model_quality), "attribution")


@query("co_select_models", "CO9", with_views(
    "SELECT model, metric FROM model_quality WHERE metric >= 0.75", "model_quality"))
def co_select_models(v):
    return CO.select_models(v.model_quality, 0.75)


@query("co_weighted_capped", "CO10", with_views(f"""
SELECT r.model, r.method, r.sample_id, r.feature, {R('r.attribution * q.metric')} AS attribution,
       least(r.ranking, 11) AS ranking
FROM ranked r JOIN model_quality q ON r.model = q.model WHERE NOT starts_with(r.feature, 'Sum')""",
    "ranked", "model_quality"))
def co_weighted_capped(v):
    return _r(CO.weighted_capped(CO.with_ranking(v.attributions), v.model_quality), "attribution")


_FEATS_SQL = "(VALUES " + ", ".join(f"('{f}')" for f in FEATURES) + ") ft(feature)"
_COMPLETE = f"""
f AS (SELECT * FROM attributions {{where}}),
r AS (SELECT *, row_number() OVER (PARTITION BY model, method, sample_id ORDER BY attribution DESC, feature)
                AS ranking FROM f),
w AS (SELECT r.model, r.method, r.sample_id, r.feature, r.attribution * q.metric AS attribution,
             least(r.ranking, 11) AS ranking
      FROM r JOIN model_quality q ON r.model = q.model WHERE NOT starts_with(r.feature, 'Sum')),
files AS (SELECT DISTINCT model, method, sample_id FROM w),
c AS (SELECT files.model, files.method, files.sample_id, ft.feature,
             coalesce(w.attribution, 0.0) AS attribution, CAST(coalesce(w.ranking, 11) AS BIGINT) AS ranking
      FROM files CROSS JOIN {_FEATS_SQL}
      LEFT JOIN w ON files.model = w.model AND files.method = w.method
                 AND files.sample_id IS NOT DISTINCT FROM w.sample_id AND ft.feature = w.feature)"""


_GAPS = "WHERE abs(attribution) >= 0.05"   # CO11 needs files that miss some features


def _completed(f, v):
    w = CO.weighted_capped(CO.with_ranking(f), v.model_quality)
    return CO.complete_features(w, FEATURES)


@query("co_complete_features", "CO11", with_views(
    f"SELECT * FROM (WITH {_COMPLETE.format(where=_GAPS)} SELECT model, method, sample_id, feature, "
    f"{R('attribution')} AS attribution, "
    f"ranking FROM c) q", "attributions", "model_quality"))
def co_complete_features(v):
    f = v.attributions.where(F.abs("attribution") >= 0.05)
    return _r(_completed(f, v), "attribution")


@query("co_by_method", "CO12", with_views(f"""
SELECT * FROM (WITH {_COMPLETE.format(where='')}
SELECT method, feature, {R('avg(abs(attribution))')} AS attribution,
       {R('coalesce(stddev_samp(abs(attribution)), 0.0)')} AS attribution_std,
       {R('avg(ranking)')} AS ranking, {R('coalesce(stddev_samp(ranking), 0.0)')} AS ranking_std
FROM c GROUP BY 1, 2) q""", "attributions", "model_quality"))
def co_by_method(v):
    return _r(CO.by_method(_completed(v.attributions, v)), "attribution", "attribution_std", "ranking", "ranking_std")


@query("co_ranks_by_sample", "CO13", with_views(f"""
SELECT p.model, p.sample_id, p.feature, {R('p.r', 2)} AS ranking FROM (
  SELECT model, sample_id, feature, count(*) AS c, avg(ranking) AS r FROM ranked
  WHERE sample_id IS NOT NULL GROUP BY 1, 2, 3) p
JOIN (SELECT model, sample_id, count(DISTINCT method) AS k FROM ranked WHERE sample_id IS NOT NULL
      GROUP BY 1, 2) m ON p.model = m.model AND p.sample_id = m.sample_id
WHERE p.c = m.k""", "ranked"))
def co_ranks_by_sample(v):
    return CO.ranks_by_sample(CO.with_ranking(v.attributions))


@query("co_global_rank", "CO14", with_views(f"""
SELECT model, feature, {R('avg(ranking)')} AS ranking, {R('coalesce(stddev_samp(ranking), 0.0)')} AS std
FROM ranked WHERE sample_id IS NOT NULL GROUP BY 1, 2""", "ranked"))
def co_global_rank(v):
    return _r(CO.global_rank(CO.with_ranking(v.attributions)), "ranking", "std")


@query("co_top10_mean_rest", "CO15", with_views(f"""
SELECT feature, {R('attribution')} AS attribution FROM (
  SELECT feature, attribution FROM (
    SELECT *, row_number() OVER (ORDER BY abs(attribution) DESC, feature) AS rn, count(*) OVER () AS cnt
    FROM brand_effects) r WHERE rn <= 10 OR cnt <= 10
  UNION ALL
  SELECT 'Sum other ' || CAST(cnt - 10 AS VARCHAR) || ' features', avg(attribution) FROM (
    SELECT *, row_number() OVER (ORDER BY abs(attribution) DESC, feature) AS rn, count(*) OVER () AS cnt
    FROM brand_effects) r WHERE rn > 10 AND cnt > 10 GROUP BY cnt) u""", "brand_effects"))
def co_top10_mean_rest(v):
    return _r(EX.shorten_global(v.brand_effects, tail="mean"), "attribution")


@query("co_scale_max_abs", "CO16", with_views(f"""
SELECT model, method, sample_id, feature,
       {R('CASE WHEN max(abs(attribution)) OVER (PARTITION BY model, method, sample_id) = 0 THEN 0.0 '
          'ELSE attribution / max(abs(attribution)) OVER (PARTITION BY model, method, sample_id) END')}
       AS attribution FROM attributions""", "attributions"))
def co_scale_max_abs(v):
    out = CO.scale_max_abs(v.attributions)
    return _r(out.select("model", "method", "sample_id", "feature", "attribution"), "attribution")
