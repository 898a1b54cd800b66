"""Queries for result tables (RS), rules (RL, ML19), data generation (GE) and IO1."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from lucerna.functions.exprs import rnd
from lucerna.operators import generate as GE
from lucerna.operators import results as RS
from lucerna.operators import rules as RL
from lucerna.operators.metrics import CLASSIFICATION_METRICS
from lucerna.plans.catalog import query
from lucerna.plans.fixtures import FEATURES
from lucerna.plans.oracle_views import R, with_views
from lucerna.sources.tables import read_table

_M = sorted(CLASSIFICATION_METRICS)
_RUNS = ("lines_1", "price_1", "qty_1", "tax_1")


# ---------------------------------------------------------------- result tables

@query("rs_metric_by_run", "RS1", with_views(
    "SELECT metric, " + ", ".join(f"max(value) FILTER (WHERE run = '{r}') AS {r}" for r in _RUNS)
    + " FROM run_metrics GROUP BY metric", "run_metrics"))
def rs_metric_by_run(v):
    return RS.metric_by_run(v.run_metrics)


@query("rs_comparison_table", "RS4", with_views(
    "SELECT model, " + ", ".join(f"max(value) FILTER (WHERE metric = '{m}') AS \"{m}\"" for m in _M)
    + " FROM run_metrics GROUP BY model", "run_metrics"))
def rs_comparison_table(v):
    return RS.comparison_table(v.run_metrics.select("model", "metric", "value"), _M)


_SUMMARY = ", ".join(f"{R(f'avg(CASE WHEN metric = {chr(39)}{m}{chr(39)} THEN value END)')} AS \"{m}\"" for m in _M)


@query("rs_multi_run_summary", "RS5", with_views(
    f"SELECT regexp_extract(run, '^([^_]*)', 1) AS key, {_SUMMARY} FROM run_metrics GROUP BY 1", "run_metrics"))
def rs_multi_run_summary(v):
    s = RS.multi_run_summary(v.run_metrics, _M)
    return s.select("key", *[rnd(F.col(f"`{m}`")).alias(m) for m in _M])


@query("rs_summary_mean_std", "RS6", with_views(
    f"SELECT * FROM (WITH s AS (SELECT regexp_extract(run, '^([^_]*)', 1) AS key, {_SUMMARY} FROM run_metrics GROUP BY 1) "
    f"SELECT * FROM s UNION ALL SELECT 'Mean', " + ", ".join(f"{R(f'avg(\"{m}\")')}" for m in _M)
    + " FROM s UNION ALL SELECT 'Std', " + ", ".join(f"{R(f'stddev_samp(\"{m}\")')}" for m in _M) + " FROM s) q",
    "run_metrics"))
def rs_summary_mean_std(v):
    s = RS.multi_run_summary(v.run_metrics, _M)
    s = s.select("key", *[rnd(F.col(f"`{m}`")).alias(m) for m in _M])
    out = RS.with_mean_std(s, _M)
    return out.select("key", *[rnd(F.col(f"`{m}`")).alias(m) for m in _M])


# ---------------------------------------------------------------- rules

@query("rl_lime_rules", "RL1", with_views(f"""
SELECT class, range, count, mean_weight, coeff FROM (
  SELECT class, range, COUNT(*) AS count, {R('avg(attribution)')} AS mean_weight,
         {R('COUNT(*) * avg(attribution)')} AS coeff,
         row_number() OVER (PARTITION BY class ORDER BY abs(COUNT(*) * avg(attribution)) DESC, range) AS r
  FROM lime_rows GROUP BY class, range) t WHERE r <= 10""", "lime_rows"))
def rl_lime_rules(v):
    out = RL.lime_rules(v.lime_rows)
    return out.select("class", "range", "count", rnd("mean_weight").alias("mean_weight"),
                      rnd("coeff").alias("coeff"))


def _preds(v):
    return RL.parse_rules(v.rules_text, FEATURES)


@query("rl_parse_rules", "RL2", with_views(
    "SELECT source, CAST(rule_no AS INTEGER) AS rule_no, CAST(cond_no AS INTEGER) AS cond_no, feature, op, value "
    "FROM rule_preds", "rule_preds"))
def rl_parse_rules(v):
    return _preds(v).select("source", F.col("rule_no").cast("int").alias("rule_no"),
                            F.col("cond_no").cast("int").alias("cond_no"), "feature", "op", "value")


@query("rl_rule_text", "ML19", with_views("""
SELECT source, CAST(rule_no AS INTEGER) AS rule_no,
       string_agg(feature || ' ' || op || ' ' || printf('%.2f', value), ' and '
                  ORDER BY cond_no, op, feature || ' ' || op || ' ' || printf('%.2f', value)) AS rule
FROM rule_preds GROUP BY 1, 2""", "rule_preds"))
def rl_rule_text(v):
    return RL.rule_text(_preds(v)).select("source", F.col("rule_no").cast("int").alias("rule_no"), "rule")


_RULE_SOURCE = "1-URGENT"


@query("rl_apply_rules", "RL3", with_views(f"""
SELECT rule_no, COUNT(*) AS support,
       {R("avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END)")} AS precision FROM (
  SELECT b.id, b.label,
         CASE WHEN b.sum_qty >= r.a AND b.sum_qty <= r.b AND CAST(b.n_lines AS DOUBLE) >= r.c THEN 0
              WHEN b.sum_tax <= r.d THEN 1 END AS rule_no
  FROM order_binary b, (SELECT
      max(CASE WHEN rule_no = 0 AND op = '>=' AND feature = 'sum_qty' THEN value END) AS a,
      max(CASE WHEN rule_no = 0 AND op = '<=' AND feature = 'sum_qty' THEN value END) AS b,
      max(CASE WHEN rule_no = 0 AND feature = 'n_lines' THEN value END) AS c,
      max(CASE WHEN rule_no = 1 THEN value END) AS d FROM rule_preds WHERE source = '{_RULE_SOURCE}') r) t
  CROSS JOIN (SELECT 1) one(x)
  JOIN (SELECT 0 AS k, 1 AS prediction UNION ALL SELECT 1, 0) c ON t.rule_no = c.k
GROUP BY rule_no""", "order_binary", "rule_preds"))
def rl_apply_rules(v):
    preds = _preds(v).where(F.col("source") == _RULE_SOURCE)
    _, stats = RL.apply_rules(v.order_binary, preds, {0: 1.0, 1: -1.0})
    return stats.select(F.col("rule_no").cast("int").alias("rule_no"), "support", rnd("precision").alias("precision"))


@query("rl_merge_ranges", "RL4", with_views(f"""
SELECT * FROM (WITH iv AS (SELECT source, rule_no, feature,
                         max(CASE WHEN op = '>=' THEN value WHEN op = '>' THEN value + 1e-5 WHEN op = '=' THEN value END) AS lo,
                         min(CASE WHEN op = '<=' THEN value WHEN op = '<' THEN value - 1e-5 WHEN op = '=' THEN value END) AS hi
                  FROM rule_preds GROUP BY 1, 2, 3),
     x AS (SELECT feature, coalesce(lo, '-inf'::DOUBLE) AS l, coalesce(hi, 'inf'::DOUBLE) AS h FROM iv),
     y AS (SELECT *, max(h) OVER (PARTITION BY feature ORDER BY l, h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm
           FROM x),
     z AS (SELECT *, sum(CASE WHEN pm IS NULL OR l > pm THEN 1 ELSE 0 END)
                       OVER (PARTITION BY feature ORDER BY l, h ROWS UNBOUNDED PRECEDING) AS island FROM y),
     m AS (SELECT feature, island, min(l) AS l, max(h) AS h FROM z GROUP BY 1, 2),
     t AS (SELECT feature, island, CASE WHEN l = '-inf'::DOUBLE THEN NULL ELSE l END AS lo,
                  CASE WHEN h = 'inf'::DOUBLE THEN NULL ELSE h END AS hi FROM m)
SELECT feature, CAST(island AS BIGINT) AS island, lo, hi,
       CASE WHEN lo IS NULL AND hi IS NOT NULL THEN feature || ' <= ' || printf('%.1f', {R('hi', 1)})
            WHEN lo IS NOT NULL AND hi IS NULL THEN feature || ' >= ' || printf('%.1f', {R('lo', 1)})
            WHEN lo IS NOT NULL AND hi IS NOT NULL THEN feature || ' >= ' || printf('%.1f', {R('lo', 1)})
                 || ' AND ' || feature || ' <= ' || printf('%.1f', {R('hi', 1)})
            ELSE feature || ' (always true)' END AS rule FROM t) q""", "rule_preds"))
def rl_merge_ranges(v):
    return RL.merge_ranges(RL.rule_intervals(_preds(v)))


# ---------------------------------------------------------------- data generation

_GE_RULES = {0: (0.2, 0.5), 2: (0.6, None)}


def _u(key, seed, salt):
    return f"(CAST(('0x' || substr(md5(CAST({key} AS VARCHAR) || '-{seed}-{salt}'), 1, 8)) AS BIGINT) / 4294967296.0)"


_GE1_SQL = f"""
SELECT id, {_u('id', 42, 'x0')} AS _u0, x1, {_u('id', 42, 'x2')} AS _u2, x3, label,
       {_u('id', 42, 'side0')} AS _s0 FROM (
  SELECT o_orderkey AS id, {_u('o_orderkey', 42, 'x1')} AS x1, {_u('o_orderkey', 42, 'x3')} AS x3,
         CAST({_u('o_orderkey', 42, 'label')} < 0.3 AS INTEGER) AS label FROM orders) t"""
_GE1_FULL = f"""
SELECT id, CASE WHEN label = 1 THEN 0.2 + 0.3 * _u0 WHEN _s0 < 0.5 THEN _u0 * 0.2 ELSE 0.5 + 0.5 * _u0 END AS x0,
       x1, CASE WHEN label = 1 THEN 0.6 + 0.4 * _u2 ELSE _u2 * 0.6 END AS x2, x3, label
FROM ({_GE1_SQL}) g"""


def _ge1(v):
    return GE.rule_dataset(v.table("orders"), "o_orderkey", 4, 0.3, _GE_RULES)


@query("ge_rule_dataset", "GE1", with_views(
    f"SELECT id, {R('x0')} AS x0, {R('x1')} AS x1, {R('x2')} AS x2, {R('x3')} AS x3, label FROM ({_GE1_FULL}) q"))
def ge_rule_dataset(v):
    d = _ge1(v)
    return d.select("id", *[rnd(f"x{i}").alias(f"x{i}") for i in range(4)], "label")


@query("ge_class_summary", "GE2", with_views(
    f"SELECT CAST(sum(label) AS BIGINT) AS positives, {R('sum(label) / count(*)')} AS ratio FROM ({_GE1_FULL}) q"))
def ge_class_summary(v):
    s = GE.class_summary(_ge1(v))
    return s.select("positives", rnd("ratio").alias("ratio"))


_GE3_COLS = ["n_lines", "sum_qty", "avg_disc"]


@query("ge_random_like", "GE3", with_views(
    "SELECT id, " + ", ".join(
        f"{R(f'CASE WHEN lo_{c} = hi_{c} THEN lo_{c} WHEN lo_{c} = floor(lo_{c}) AND hi_{c} = floor(hi_{c}) '
             f'THEN floor(lo_{c} + (hi_{c} - lo_{c} + 1.0) * {_u("id", 42, c)}) '
             f'ELSE lo_{c} + (hi_{c} - lo_{c}) * {_u("id", 42, c)} END')} AS {c}" for c in _GE3_COLS)
    + " FROM order_features, (SELECT " + ", ".join(
        f"min(CAST({c} AS DOUBLE)) AS lo_{c}, max(CAST({c} AS DOUBLE)) AS hi_{c}" for c in _GE3_COLS)
    + " FROM order_features) s", "order_features"))
def ge_random_like(v):
    out = GE.random_like(v.order_features, "id", _GE3_COLS)
    return out.select("id", *[rnd(c).alias(c) for c in _GE3_COLS])


@query("ge_one_hot_groups", "GE4")
def ge_one_hot_groups(v):
    brands = sorted(r[0] for r in v.table("part").select("p_brand").distinct().collect())
    return GE.one_hot_groups(v.table("part"), "p_partkey", {"brand": [f"brand_{b}" for b in brands]})


# ---------------------------------------------------------------- IO

@query("io_read_table", "IO1", with_views("SELECT * FROM part"))
def io_read_table(v):
    return read_table(v.spark, os.path.join(v.sf_dir, "part.parquet"))
