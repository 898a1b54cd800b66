"""Queries for the explanation methods (EX1-EX22).

Deterministic methods are checked with a fixed logistic formula as the
model (f = sigmoid(-5 + 0.04 sum_qty + 0.25 n_lines)) so the SQL oracle can
score perturbed rows too; fitted-model variants are registered rows-only.
"""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from lucerna.functions.exprs import rnd
from lucerna.operators import explain as EX
from lucerna.operators import models as ML
from lucerna.operators import sample as SA
from lucerna.plans.catalog import query
from lucerna.plans.fixtures import FEATURES
from lucerna.plans.oracle_views import R, with_views

# Fixed model of the checked explanation queries.
LOGIT = {"sum_qty": 0.04, "n_lines": 0.25}
INTERCEPT = -5.0
LINEAR = {"n_lines": 0.25, "sum_qty": 0.04, "avg_disc": -3.0, "sum_tax": 2.0,
          "n_returned": -0.1, "total_price": 0.000001}


def _logit_col():
    z = F.lit(INTERCEPT)
    for f, w in LOGIT.items():
        z = z + F.lit(w) * F.col(f).cast("double")
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


SCORER = EX.expr_scorer(_logit_col)
_Z_SQL = "(-5.0 + 0.04 * CAST(sum_qty AS DOUBLE) + 0.25 * CAST(n_lines AS DOUBLE))"
_P_SQL = f"(1.0 / (1.0 + exp(-{_Z_SQL})))"


# ---------------------------------------------------------------- Shapley

@query("ex_linear_shapley", "EX6", with_views(" UNION ALL ".join(
    f"SELECT id, '{f}' AS feature, {R(f'{w!r} * (CAST({f} AS DOUBLE) - (SELECT avg(CAST({f} AS DOUBLE)) FROM order_features))')} "
    f"AS attribution, CAST({f} AS DOUBLE) AS value FROM order_features" for f, w in LINEAR.items()),
    "order_features"))
def ex_linear_shapley(v):
    of = v.order_features
    local = EX.linear_shapley(of, LINEAR, of)
    return local.select("id", "feature", rnd("attribution").alias("attribution"), "value")


@query("ex_shapley_global", "EX7", with_views(f"""
SELECT model, feature, {R('sum(abs(attribution))')} AS attribution FROM attributions
WHERE method = 'Shapley' GROUP BY model, feature""", "attributions"))
def ex_shapley_global(v):
    a = v.attributions.where(F.col("method") == "Shapley")
    return EX.shapley_global(a, ["model"]).select("model", "feature", rnd("attribution").alias("attribution"))


@query("ex_shapley_fitted_lr", "EX6,EX7,ML9")
def ex_shapley_fitted_lr(v):
    ob = v.order_binary
    split = SA.train_test_split(ob).persist()  # it feeds a fit, the means and the explained rows
    train = split.where("split = 'train'")
    m = ML.fit_model(train, "LR", "classification", FEATURES)
    coefs = ML.linear_coefficients(m, FEATURES)
    local = EX.linear_shapley(split.where("split = 'test'"), {c: coefs[c] for c in FEATURES}, train)
    return EX.shapley_global(local)


# ---------------------------------------------------------------- integrated gradients

_IG_SQL = f"""
SELECT * FROM (WITH b AS (SELECT avg(CAST(sum_qty AS DOUBLE)) AS mq, avg(CAST(n_lines AS DOUBLE)) AS ml
                          FROM order_features),
     r AS (SELECT id, CAST(sum_qty AS DOUBLE) AS q, CAST(n_lines AS DOUBLE) AS l, mq, ml,
                  {_Z_SQL} AS zx, (0.04 * mq + 0.25 * ml) + -5.0 AS zb FROM order_features, b),
     p AS (SELECT id, k.range AS k, 1.0 / (1.0 + exp(-(zb + (CAST(k.range AS DOUBLE) / 50.0) * (zx - zb)))) AS p
           FROM r, range(51) k),
     g AS (SELECT id, sum(CASE WHEN k = 0 OR k = 50 THEN 0.5 / 50 ELSE 1.0 / 50 END * p * (1.0 - p)) AS g
           FROM p GROUP BY id),
     loc AS (SELECT r.id, 'sum_qty' AS feature, (q - mq) * 0.04 * g AS a FROM r JOIN g ON r.id = g.id
             UNION ALL SELECT r.id, 'n_lines', (l - ml) * 0.25 * g FROM r JOIN g ON r.id = g.id)
{{select}}) t"""


def _ig(v):
    of = v.order_features
    base = of.agg(*[F.avg(F.col(f).cast("double")).alias(f) for f in LOGIT]).first().asDict()
    return EX.integrated_gradients_logistic(of, LOGIT, INTERCEPT, base)


@query("ex_integrated_gradients", "EX8", with_views(
    _IG_SQL.format(select=f"SELECT id, feature, {R('a')} AS attribution FROM loc"), "order_features"))
def ex_integrated_gradients(v):
    return _ig(v).select("id", "feature", rnd("attribution").alias("attribution"))


@query("ex_integrated_gradients_global", "EX9", with_views(
    _IG_SQL.format(select=f"SELECT feature, {R('avg(a)')} AS attribution, {R('stddev_pop(a)')} AS std "
                          f"FROM loc GROUP BY feature"), "order_features"))
def ex_integrated_gradients_global(v):
    g = EX.global_mean_std(_ig(v), pop=True)
    return g.select("feature", rnd("attribution").alias("attribution"), rnd("std").alias("std"))


@query("ex_integrated_gradients_scorer", "EX8", with_views(
    _IG_SQL.format(select=f"SELECT id, feature, {R('a', 4)} AS attribution FROM loc" + "".join(
        f" UNION ALL SELECT id, '{f}', 0.0 FROM order_features" for f in FEATURES if f not in LOGIT)),
    "order_features"))
def ex_integrated_gradients_scorer(v):
    # checked against the closed form of the same model; difference quotients agree with it to about 1e-9
    of = v.order_features
    base = of.agg(*[F.avg(F.col(f).cast("double")).alias(f) for f in FEATURES]).first().asDict()
    out = EX.integrated_gradients(of, base, FEATURES, SCORER)
    return out.select("id", "feature", rnd("attribution", 4).alias("attribution"))


@query("ex_integrated_gradients_fitted", "EX8,EX9,ML2")
def ex_integrated_gradients_fitted(v):
    m, train, test = _fitted(v, "ANN")
    base = train.agg(*[F.avg(F.col(f).cast("double")).alias(f) for f in FEATURES]).first().asDict()
    return EX.global_mean_std(EX.integrated_gradients(test, base, FEATURES, EX.pipeline_scorer(m, 1)))


# ---------------------------------------------------------------- PDP / ICE / ALE

@query("ex_pdp", "EX12", with_views(f"""
SELECT {R('g')} AS grid_value, {R('avg(p)')} AS mean_prediction FROM (
  SELECT g.g, 1.0 / (1.0 + exp(-(-5.0 + 0.04 * g.g + 0.25 * CAST(o.n_lines AS DOUBLE)))) AS p
  FROM order_features o,
       (SELECT q05 + (q95 - q05) * CAST(i.range AS DOUBLE) / 99.0 AS g
        FROM (SELECT quantile_cont(sum_qty, 0.05) AS q05, quantile_cont(sum_qty, 0.95) AS q95
              FROM order_features) q, range(100) i) g) t GROUP BY g""", "order_features"))
def ex_pdp(v):
    of = v.order_features.select("id", "sum_qty", "n_lines")
    out = EX.partial_dependence(of, "sum_qty", SCORER)
    return out.select(rnd("grid_value").alias("grid_value"), rnd("mean_prediction").alias("mean_prediction"))


@query("ex_pdp_distinct_grid", "EX12", with_views(f"""
SELECT CAST(g.g AS DOUBLE) AS grid_value,
       {R('avg(1.0 / (1.0 + exp(-(-5.0 + 0.04 * CAST(o.sum_qty AS DOUBLE) + 0.25 * g.g))))')} AS mean_prediction
FROM order_features o, (SELECT DISTINCT CAST(n_lines AS DOUBLE) AS g FROM order_features) g GROUP BY g.g""",
    "order_features"))
def ex_pdp_distinct_grid(v):
    of = v.order_features.select("id", "sum_qty", "n_lines")
    out = EX.partial_dependence(of, "n_lines", SCORER)
    return out.select("grid_value", rnd("mean_prediction").alias("mean_prediction"))


@query("ex_ice", "EX13", with_views(f"""
SELECT s.id, g.g AS grid_value,
       {R('1.0 / (1.0 + exp(-(-5.0 + 0.04 * CAST(s.sum_qty AS DOUBLE) + 0.25 * g.g)))')} AS prediction
FROM order_features s,
     (SELECT DISTINCT CAST(n_lines AS DOUBLE) AS g FROM order_features) g""", "order_features"))
def ex_ice(v):
    of = v.order_features.select("id", "sum_qty", "n_lines")
    grid = EX.pdp_grid(of, "n_lines")
    out = EX.partial_dependence(EX.ice_rows(of), "n_lines", SCORER, grid, per_row=True)
    return out.select("id", "grid_value", rnd("prediction").alias("prediction"))


def _sig(x):
    return f"(1.0 / (1.0 + exp(-(-5.0 + 0.04 * ({x}) + 0.25 * CAST(n_lines AS DOUBLE)))))"


_ALE_SQL = f"""
SELECT * FROM (WITH e AS (SELECT list_sort(list_distinct(list_value(
            {', '.join(f'quantile_cont(CAST(sum_qty AS DOUBLE), {i / 10})' for i in range(11))}))) AS edges
            FROM order_features),
     b AS (SELECT o.*, greatest(len(list_filter(e.edges, lambda x: x < CAST(o.sum_qty AS DOUBLE))), 1) AS bin, e.edges
           FROM order_features o, e),
     d AS (SELECT bin, edges[bin] AS lower, edges[bin + 1] AS upper,
                  {_sig('edges[bin + 1]')} - {_sig('edges[bin]')} AS diff FROM b),
     eff AS (SELECT bin, lower, upper, COUNT(*) AS n, avg(diff) AS effect FROM d GROUP BY 1, 2, 3),
     acc AS (SELECT *, sum(effect) OVER (ORDER BY bin ROWS UNBOUNDED PRECEDING) AS ale FROM eff),
     pr AS (SELECT *, coalesce(lag(ale) OVER (ORDER BY bin), 0.0) AS prev FROM acc),
     c AS (SELECT sum(n * (prev + ale) / 2.0) / sum(n) AS c FROM pr)
SELECT CAST(bin AS INTEGER) AS bin, {R('lower')} AS lower, {R('upper')} AS upper, n,
       {R('effect')} AS effect, {R('ale - c')} AS ale FROM pr, c) t"""


@query("ex_ale", "EX14", with_views(_ALE_SQL, "order_features"))
def ex_ale(v):
    of = v.order_features.select("id", "sum_qty", "n_lines")
    out = EX.ale(of, "sum_qty", SCORER, 10)
    return out.select(F.col("bin").cast("int").alias("bin"), rnd("lower").alias("lower"),
                      rnd("upper").alias("upper"), "n", rnd("effect").alias("effect"), rnd("ale").alias("ale"))


_CLASS_TERMS = ("-x / 100.0", "0.5", "x / 100.0 - 1.0")  # logits of three classes of a fixed model over sum_qty


def _class_scorer(df):
    e = [F.exp(F.expr(t.replace("x", "CAST(sum_qty AS DOUBLE)"))) for t in _CLASS_TERMS]
    return df.withColumn("probability", F.array(*[v / (e[0] + e[1] + e[2]) for v in e]))


def _share(k: int, x: str) -> str:
    e = [f"exp({t.replace('x', x)})" for t in _CLASS_TERMS]
    return f"{e[k]} / ({e[0]} + {e[1]} + {e[2]})"


_ALE_CLASS_SQL = f"""
SELECT * FROM (WITH e AS (SELECT list_sort(list_distinct(list_value(
            {', '.join(f'quantile_cont(CAST(sum_qty AS DOUBLE), {i / 10})' for i in range(11))}))) AS edges
            FROM order_features),
     b AS (SELECT greatest(len(list_filter(e.edges, lambda x: x < CAST(o.sum_qty AS DOUBLE))), 1) AS bin, e.edges
           FROM order_features o, e),
     g AS (SELECT bin, edges[bin] AS lower, edges[bin + 1] AS upper, COUNT(*) AS n FROM b GROUP BY 1, 2, 3),
     eff AS ({' UNION ALL '.join(f"SELECT {k} AS class, *, {_share(k, 'upper')} - {_share(k, 'lower')} AS effect FROM g" for k in range(3))}),
     acc AS (SELECT *, sum(effect) OVER (PARTITION BY class ORDER BY bin ROWS UNBOUNDED PRECEDING) AS ale FROM eff),
     pr AS (SELECT *, coalesce(lag(ale) OVER (PARTITION BY class ORDER BY bin), 0.0) AS prev FROM acc),
     c AS (SELECT class, sum(n * (prev + ale) / 2.0) / sum(n) AS c FROM pr GROUP BY 1)
SELECT pr.class, CAST(bin AS INTEGER) AS bin, {R('lower')} AS lower, {R('upper')} AS upper, n,
       {R('effect')} AS effect, {R('ale - c')} AS ale FROM pr JOIN c ON pr.class = c.class) t"""


@query("ex_ale_classes", "EX14", with_views(_ALE_CLASS_SQL, "order_features"))
def ex_ale_classes(v):
    out = EX.ale(v.order_features.select("id", "sum_qty"), "sum_qty", _class_scorer, 10, per_class=True)
    return out.select("class", F.col("bin").cast("int").alias("bin"), rnd("lower").alias("lower"), rnd("upper").alias("upper"),
                      "n", rnd("effect").alias("effect"), rnd("ale").alias("ale"))


# ---------------------------------------------------------------- anchors

_ANCHOR_COLS = FEATURES


def _anchor_sql(select_local: str) -> str:
    cols = _ANCHOR_COLS
    subsets = [s for k in range(1, len(cols) + 1) for s in itertools.combinations(cols, k)]

    def txt(c):
        q = [f"printf('%.2f', {R(f'q{j}_{c}', 2)})" for j in (1, 2, 3)]
        return (f"CASE WHEN b_{c} = 0 THEN '{c} <= ' || {q[0]} "
                f"WHEN b_{c} = 1 THEN {q[0]} || ' < {c} <= ' || {q[1]} "
                f"WHEN b_{c} = 2 THEN {q[1]} || ' < {c} <= ' || {q[2]} "
                f"ELSE '{c} > ' || {q[2]} END")
    qcols = ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), {p}) AS q{j}_{c}"
                      for c in cols for j, p in ((1, 0.25), (2, 0.5), (3, 0.75)))
    bins = ", ".join(f"CASE WHEN CAST({c} AS DOUBLE) <= q1_{c} THEN 0 WHEN CAST({c} AS DOUBLE) <= q2_{c} THEN 1 "
                     f"WHEN CAST({c} AS DOUBLE) <= q3_{c} THEN 2 ELSE 3 END AS b_{c}" for c in cols)
    parts = []
    for i, s in enumerate(subsets):
        key = " || ',' || ".join(f"CAST(b_{c} AS VARCHAR)" for c in s)
        rule = " || ' AND ' || ".join(txt(c) for c in s)
        parts.append(f"SELECT id, split, prediction, {i} AS sub, {len(s)} AS size, {key} AS key, {rule} AS rule FROM bb")
    return f"""
SELECT * FROM (WITH sp AS (SELECT p.id, p.prediction, {', '.join(f'f.{c}' for c in cols)},
                                CASE WHEN row_number() OVER (ORDER BY md5(CAST(p.id AS VARCHAR) || '-2020'), p.id)
                                     <= floor(count(*) OVER () * 0.8) THEN 'train' ELSE 'test' END AS split
                         FROM order_pred p JOIN order_features f ON p.id = f.id),
     q AS (SELECT {qcols} FROM sp WHERE split = 'train'),
     bb AS (SELECT sp.*, q.*, {bins} FROM sp, q),
     cand AS ({' UNION ALL '.join(parts)}),
     cnt AS (SELECT sub, key, prediction, COUNT(*) AS c FROM cand WHERE split = 'train' GROUP BY 1, 2, 3),
     cov AS (SELECT sub, key, SUM(c) AS cv FROM cnt GROUP BY 1, 2),
     ntr AS (SELECT COUNT(*) AS n FROM sp WHERE split = 'train'),
     sc AS (SELECT e.id, e.rule, e.size,
                   coalesce(CAST(s.c AS DOUBLE) / cov.cv, 0.0) AS precision,
                   coalesce(cov.cv, 0) / CAST(ntr.n AS DOUBLE) AS coverage
            FROM cand e LEFT JOIN cov ON e.sub = cov.sub AND e.key = cov.key
            LEFT JOIN cnt s ON e.sub = s.sub AND e.key = s.key AND e.prediction = s.prediction, ntr
            WHERE e.split = 'test'),
     best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY
                CASE WHEN precision >= 0.95 THEN 0 ELSE 1 END,
                CASE WHEN precision >= 0.95 THEN size ELSE 0 END,
                CASE WHEN precision >= 0.95 THEN -coverage ELSE -precision END,
                size, -coverage, rule) AS r FROM sc),
     loc AS (SELECT id, rule, CAST(size AS INTEGER) AS size, precision, coverage FROM best WHERE r = 1)
{select_local}) t"""


def _anchors(v):
    ob = v.order_pred.join(v.order_features.select("id", *_ANCHOR_COLS), "id")
    split = SA.train_test_split(ob)
    return EX.anchors(split.where("split = 'train'"), split.where("split = 'test'"), _ANCHOR_COLS)


@query("ex_anchors", "EX15", with_views(_anchor_sql(
    f"SELECT id, rule, size, {R('precision')} AS precision, {R('coverage')} AS coverage FROM loc"),
    "order_pred", "order_features"))
def ex_anchors(v):
    a = _anchors(v)
    return a.select("id", "rule", F.col("size").cast("int").alias("size"), rnd("precision").alias("precision"),
                    rnd("coverage").alias("coverage"))


@query("ex_anchors_global", "EX16", with_views(_anchor_sql(
    f"SELECT rule AS feature, {R('avg(precision)')} AS precision, "
    f"{R('coalesce(stddev_samp(precision), 0.0)')} AS std, {R('sum(coverage)')} AS coverage, "
    f"{R('avg(precision)')} AS attribution FROM loc GROUP BY rule"), "order_pred", "order_features"))
def ex_anchors_global(v):
    g = EX.anchors_global(_anchors(v))
    return g.select("feature", *[rnd(c).alias(c) for c in ("precision", "std", "coverage", "attribution")])


# ---------------------------------------------------------------- counterfactuals

_CF_COLS = FEATURES


def _cf_sql(select: str) -> str:
    def u(seed, c):
        return (f"(CAST(('0x' || substr(md5(CAST(id AS VARCHAR) || '-{seed}-' || CAST(cf AS VARCHAR) "
                f"|| '-{c}'), 1, 8)) AS BIGINT) / 4294967296.0)")
    ch = {c: f"({u(0, c)} < 0.3)" for c in _CF_COLS}
    val = {c: f"(lo_{c} + (hi_{c} - lo_{c}) * {u('0-v', c)})" for c in _CF_COLS}
    newv = {c: f"CASE WHEN {ch[c]} THEN {val[c]} ELSE CAST({c} AS DOUBLE) END" for c in _CF_COLS}
    span = {c: f"(CASE WHEN hi_{c} - lo_{c} = 0 THEN 1.0 ELSE hi_{c} - lo_{c} END)" for c in _CF_COLS}
    dist = " + ".join(f"CASE WHEN {ch[c]} THEN abs({val[c]} - CAST({c} AS DOUBLE)) / {span[c]} ELSE 0.0 END"
                      for c in _CF_COLS)
    nchg = " + ".join(f"CASE WHEN {ch[c]} THEN 1 ELSE 0 END" for c in _CF_COLS)
    rng = ", ".join(f"min(CAST({c} AS DOUBLE)) AS lo_{c}, max(CAST({c} AS DOUBLE)) AS hi_{c}" for c in _CF_COLS)
    return f"""
SELECT * FROM (WITH rg AS (SELECT {rng} FROM order_features),
     o AS (SELECT id, {', '.join(_CF_COLS)}, {_P_SQL} AS orig FROM order_features),
     c AS (SELECT o.*, rg.*, unnest(generate_series(0, 99)) AS cf FROM o, rg),
     n AS (SELECT id, cf, orig, {', '.join(f'{newv[c]} AS x_{c}' for c in _CF_COLS)},
                  {', '.join(f'CASE WHEN {ch[c]} THEN 1 ELSE 0 END AS c_{c}' for c in _CF_COLS)},
                  {nchg} AS nchg, {dist} AS dist FROM c),
     s AS (SELECT *, 1.0 / (1.0 + exp(-(-5.0 + 0.04 * x_sum_qty + 0.25 * x_n_lines))) AS score FROM n),
     k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY nchg, dist, cf) AS rk FROM s
           WHERE ((score >= 0.5) <> (orig >= 0.5)) AND nchg > 0),
     kept AS (SELECT * FROM k WHERE rk <= 10),
     lng AS ({' UNION ALL '.join(f"SELECT id, cf, '{c}' AS feature, x_{c} AS value, c_{c} = 1 AS changed FROM kept" for c in _CF_COLS)})
{select}) t"""


def _cf(v, find=EX.counterfactuals):
    of = v.order_features.select("id", *_CF_COLS)
    desired = lambda s, o: (s >= 0.5) != (o >= 0.5)  # noqa: E731 -- the opposite class
    return find(of, of, _CF_COLS, SCORER, desired)


@query("ex_counterfactuals", "EX10", with_views(_cf_sql(
    f"SELECT id, CAST(cf AS INTEGER) AS cf, feature, {R('value')} AS value, changed FROM lng"), "order_features"))
def ex_counterfactuals(v):
    return _cf(v).select("id", F.col("cf").cast("int").alias("cf"), "feature", rnd("value").alias("value"),
                         "changed")


@query("ex_dice_importance", "EX11", with_views(_cf_sql(f"""
SELECT feature, {R('avg(a)')} AS attribution, {R('stddev_pop(a)')} AS std FROM (
  SELECT id, feature, avg(CASE WHEN changed THEN 1.0 ELSE 0.0 END) AS a FROM lng GROUP BY id, feature) l
GROUP BY feature"""), "order_features"))
def ex_dice_importance(v):
    g = EX.dice_importance(_cf(v, EX.kept_counterfactuals), feature_cols=_CF_COLS)
    return g.select("feature", rnd("attribution").alias("attribution"), rnd("std").alias("std"))


# ---------------------------------------------------------------- LIME tables

@query("ex_lime_global", "EX4", with_views(f"""
SELECT model, feature, {R('avg(attribution)')} AS attribution, {R('stddev_samp(attribution)')} AS std
FROM (SELECT model, attribution,
             trim(regexp_replace(regexp_replace(range, '^-?[0-9]+(\\.[0-9]+)?\\s*(<=|>=|<|>|=)\\s*', ''),
                                 '\\s*(<=|>=|<|>|=)\\s*-?[0-9]+(\\.[0-9]+)?$', '')) AS feature
      FROM lime_rows) l GROUP BY model, feature""", "lime_rows"))
def ex_lime_global(v):
    g = EX.lime_global(v.lime_rows, ["model"])
    return g.select("model", "feature", rnd("attribution").alias("attribution"), rnd("std").alias("std"))


# ---------------------------------------------------------------- table shaping

@query("ex_sort_by_magnitude", "EX18,IO3", with_views("""
SELECT model, method, feature, attribution,
       CAST(row_number() OVER (PARTITION BY model, method ORDER BY abs(attribution) DESC, feature) AS BIGINT) AS rank
FROM attributions WHERE sample_id IS NULL""", "attributions"))
def ex_sort_by_magnitude(v):
    from pyspark.sql import Window
    g = v.attributions.where(F.col("sample_id").isNull())
    w = Window.partitionBy("model", "method").orderBy(F.abs("attribution").desc(), "feature")
    return g.select("model", "method", "feature", "attribution",
                    F.row_number().over(w).cast("long").alias("rank"))


@query("ex_shorten_top10", "EX19", with_views(f"""
SELECT feature, {R('attribution')} AS attribution FROM (
  SELECT feature, attribution FROM (
    SELECT *, row_number() OVER (ORDER BY abs(attribution) DESC, feature) AS rn, count(*) OVER () AS cnt
    FROM brand_effects) r WHERE rn <= 10 OR cnt <= 10
  UNION ALL
  SELECT 'Sum other ' || CAST(cnt - 10 AS VARCHAR) || ' features', sum(attribution) FROM (
    SELECT *, row_number() OVER (ORDER BY abs(attribution) DESC, feature) AS rn, count(*) OVER () AS cnt
    FROM brand_effects) r WHERE rn > 10 AND cnt > 10 GROUP BY cnt) u""", "brand_effects"))
def ex_shorten_top10(v):
    out = EX.shorten_global(v.brand_effects)
    return out.select("feature", rnd("attribution").alias("attribution"))


@query("ex_summarise_local", "EX20", with_views(f"""
SELECT sample_id, feature, {R('attribution')} AS attribution,
       CAST(row_number() OVER (PARTITION BY sample_id ORDER BY attribution DESC, feature) AS BIGINT) AS position
FROM (
  SELECT sample_id, feature, attribution FROM (
    SELECT *, count(*) OVER (PARTITION BY sample_id) AS cnt FROM flag_brand_effects) r WHERE rank <= 10 OR cnt <= 10
  UNION ALL
  SELECT sample_id, 'Sum other ' || CAST(cnt - 10 AS VARCHAR) || ' features', sum(attribution) FROM (
    SELECT *, count(*) OVER (PARTITION BY sample_id) AS cnt FROM flag_brand_effects) r
  WHERE rank > 10 AND cnt > 10 GROUP BY sample_id, cnt) u""", "flag_brand_effects"))
def ex_summarise_local(v):
    out = EX.summarise_local(v.flag_brand_effects, ["sample_id"])
    return out.select("sample_id", "feature", rnd("attribution").alias("attribution"), "position")


@query("ex_sample_confidence", "EX21", with_views(
    "SELECT id, greatest(p0, p1, p2) AS confidence FROM order_pred_multi", "order_pred_multi"))
def ex_sample_confidence(v):
    return EX.sample_confidence(v.order_pred_multi)


@query("ex_attribution_share", "EX22", with_views(f"""
SELECT model, method, feature,
       {R('CASE WHEN sum(abs(attribution)) OVER (PARTITION BY model, method) = 0 THEN 0.0 '
          'ELSE 100.0 * abs(attribution) / sum(abs(attribution)) OVER (PARTITION BY model, method) END')} AS share
FROM attributions WHERE sample_id IS NULL""", "attributions"))
def ex_attribution_share(v):
    g = v.attributions.where(F.col("sample_id").isNull())
    return EX.attribution_share(g, ["model", "method"]).select("model", "method", "feature",
                                                               rnd("share").alias("share"))


# ---------------------------------------------------------------- fitted-model explainers (rows-only)

def _fitted(v, name="LR", params=None, few=False):
    ob = v.order_binary
    # the split feeds a fit, quantiles and the explained rows: materialise it once
    split = SA.train_test_split(ob).persist()
    train = split.where("split = 'train'")
    test = split.where("split = 'test'")
    m = ML.fit_model(ML.few_partitions(train) if few else train, name, "classification", FEATURES, params=params)
    return m, train, test


# the permutation of a repeat, as the operator defines it: rank i of one salted md5 order -> rank i of another
_PERM_RANK = "row_number() OVER (PARTITION BY r ORDER BY md5(id || '|' || r || '-0-{o}'), id || '|' || r)"
_PERM_HIT = "CASE WHEN round(1.0 / (1.0 + exp(-(-5.0 + 0.04 * {q} + 0.25 * {n})))) = label THEN 1.0 ELSE 0.0 END"
_PERM_P = "(1.0 / (1.0 + exp(-(-5.0 + 0.04 * {q} + 0.25 * {n}))))"
_PERM_Z = "(({q} - 100.0) / 25.0 + ({n} - 4.0) * 0.25)"


def _perm_sql(view: str, value: str, metric: str) -> str:
    """Importance of all features by a metric over (f, r, label, x): x is ``value`` of the (permuted) sum_qty and n_lines.

    The model uses these two features alone: permuting another one changes nothing.
    """
    none = " UNION ALL ".join(f"SELECT '{f}' AS feature, 0.0 AS d" for f in FEATURES if f not in ("sum_qty", "n_lines"))
    return f"""
SELECT * FROM (WITH t AS (SELECT CAST(id AS VARCHAR) AS id, label, CAST(sum_qty AS DOUBLE) AS q,
                                 CAST(n_lines AS DOUBLE) AS n FROM {view}),
     e AS (SELECT t.*, CAST(r AS VARCHAR) AS r FROM t, range(5) x(r)),
     a AS (SELECT *, {_PERM_RANK.format(o='a')} AS k FROM e),
     b AS (SELECT r, q AS pq, n AS pn, {_PERM_RANK.format(o='b')} AS k FROM e),
     j AS (SELECT * FROM a JOIN b USING (r, k)),
     s AS (SELECT 'sum_qty' AS f, r, label, {value.format(q='pq', n='n')} AS x FROM j UNION ALL
           SELECT 'n_lines', r, label, {value.format(q='q', n='pn')} FROM j UNION ALL
           SELECT '', '', label, {value.format(q='q', n='n')} FROM t),
     m AS ({metric}),
     u AS (SELECT m.f AS feature, z.m - m.m AS d FROM m, (SELECT m FROM m WHERE f = '') z WHERE m.f <> '' UNION ALL {none})
SELECT feature, {R('avg(d)')} AS attribution, {R('stddev_pop(d)')} AS std FROM u GROUP BY feature) p"""


_AUC_METRIC = ("SELECT f, r, (sum(CASE WHEN label = 1 THEN k ELSE 0 END) - count_if(label = 1) * (count_if(label = 1) + 1) / 2.0) "
               "/ (CAST(count_if(label = 1) AS DOUBLE) * count_if(label = 0)) AS m FROM (SELECT f, r, label, rank() OVER (PARTITION BY f, r ORDER BY x) "
               "+ (count(*) OVER (PARTITION BY f, r, x) - 1) / 2.0 AS k FROM s) y GROUP BY f, r")


@query("ex_permutation_checked", "EX1", with_views(_perm_sql("order_binary", _PERM_HIT, "SELECT f, r, avg(x) AS m FROM s GROUP BY f, r"),
                                                   "order_binary"))
def ex_permutation_checked(v):
    out = EX.permutation_importance(v.order_binary, FEATURES, SCORER, repeats=5, scoring="accuracy")
    return out.select("feature", rnd("attribution").alias("attribution"), rnd("std").alias("std"))


@query("ex_permutation_auc", "EX1", with_views(_perm_sql("order_binary", R(_PERM_P, 9), _AUC_METRIC), "order_binary"))
def ex_permutation_auc(v):
    # nine decimals: the engines agree on which scores are equal
    out = EX.permutation_importance(v.order_binary, FEATURES, EX.expr_scorer(lambda: rnd(_logit_col(), 9)), repeats=5)
    return out.select("feature", rnd("attribution").alias("attribution"), rnd("std").alias("std"))


def _softmax(df):
    """Three classes with logits (-z, 0.5, z), z being that of the prediction view."""
    z = (F.col("sum_qty").cast("double") - 100.0) / 25.0 + (F.col("n_lines").cast("double") - 4.0) * 0.25
    e = [F.exp(-z), F.exp(F.lit(0.5)), F.exp(z)]
    return df.withColumn("probability", F.array(*[x / (e[0] + e[1] + e[2]) for x in e]))


@query("ex_permutation_log_loss", "EX1", with_views(_perm_sql(
    "order_multi", "ln(greatest((CASE label WHEN 0 THEN exp(-Z) WHEN 1 THEN exp(0.5) ELSE exp(Z) END) / (exp(-Z) + exp(0.5) + exp(Z)), 1e-15))"
    .replace("Z", _PERM_Z), "SELECT f, r, avg(x) AS m FROM s GROUP BY f, r"), "order_multi"))
def ex_permutation_log_loss(v):
    out = EX.permutation_importance(v.order_multi, FEATURES, _softmax, repeats=5, n_classes=3)
    return out.select("feature", rnd("attribution").alias("attribution"), rnd("std").alias("std"))


@query("ex_permutation_importance", "EX1")
def ex_permutation_importance(v):
    m, train, _ = _fitted(v)
    return EX.permutation_importance(train, FEATURES, EX.pipeline_scorer(m, 1), repeats=5)


@query("ex_forest_importance", "EX2")
def ex_forest_importance(v):
    _, _, test = _fitted(v)
    return EX.forest_importance(test, FEATURES, "classification")


@query("ex_pdp_fitted", "EX12,ML2")
def ex_pdp_fitted(v):
    m, train, _ = _fitted(v, "RF")
    return EX.partial_dependence(train, "sum_qty", EX.pipeline_scorer(m, 1))


@query("ex_ale_fitted", "EX14,ML4")
def ex_ale_fitted(v):
    m, train, _ = _fitted(v, "XGBOOST", {"maxIter": 30})
    return EX.ale(train, "sum_qty", EX.pipeline_scorer(m, 1))


def _cuts_sql(cols, depth=3) -> str:
    """Entropy cuts of order_binary: three levels of the best split of every interval."""
    x = " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS v, label FROM order_binary" for c in cols)
    h = lambda p, n: (f"-(CASE WHEN {p} > 0 THEN {p} / ({p} + {n}) * log2({p} / ({p} + {n})) ELSE 0.0 END"  # noqa: E731
                      f" + CASE WHEN {n} > 0 THEN {n} / ({p} + {n}) * log2({n} / ({p} + {n})) ELSE 0.0 END)")
    ctes = [f"x AS ({x})",
            "d AS (SELECT feature, v, CAST(sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS n0, "
            "CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS n1 FROM x WHERE v IS NOT NULL AND label IS NOT NULL GROUP BY 1, 2)",
            "c0 AS (SELECT '' AS feature, 0.0::DOUBLE AS cut WHERE false)"]
    for i in range(1, depth + 1):
        ctes += [
            f"p{i} AS (SELECT d.*, (SELECT count(*) FROM c{i - 1} c WHERE c.feature = d.feature AND c.cut < d.v) AS node FROM d)",
            f"r{i} AS (SELECT *, sum(n0) OVER l AS l0, sum(n1) OVER l AS l1, sum(n0) OVER w AS t0, sum(n1) OVER w AS t1, "
            f"lead(v) OVER (PARTITION BY feature, node ORDER BY v) AS nv FROM p{i} "
            "WINDOW l AS (PARTITION BY feature, node ORDER BY v), w AS (PARTITION BY feature, node))",
            f"g{i} AS (SELECT *, {R('%s - ((l0 + l1) * %s + (t0 + t1 - l0 - l1) * %s) / (t0 + t1)' % (h('t0', 't1'), h('l0', 'l1'), h('(t0 - l0)', '(t1 - l1)')), 9)} "
            f"AS gain FROM r{i} WHERE nv IS NOT NULL AND t0 > 0 AND t1 > 0)",
            f"b{i} AS (SELECT *, row_number() OVER (PARTITION BY feature, node ORDER BY gain DESC, v) AS k FROM g{i})",
            f"c{i} AS (SELECT * FROM c{i - 1} UNION SELECT feature, (v + nv) / 2.0 FROM b{i} WHERE k = 1 AND gain > 0)"]
    ctes.append("m AS (SELECT feature, quantile_cont(v, 0.5) AS cut FROM x WHERE v IS NOT NULL AND label IS NOT NULL "
                f"AND feature NOT IN (SELECT feature FROM c{depth}) GROUP BY feature)")
    return f"WITH {', '.join(ctes)} SELECT feature, {R('cut')} AS cut FROM (SELECT * FROM c{depth} UNION ALL SELECT * FROM m) q"


@query("ex_lime_cuts", "EX3", with_views(f"SELECT * FROM ({_cuts_sql(FEATURES)}) t", "order_binary"))
def ex_lime_cuts(v):
    from lucerna.operators.discretise import entropy_cuts
    cuts = entropy_cuts(v.order_binary, FEATURES)
    out = v.spark.createDataFrame([(c, float(x)) for c, found in cuts.items() for x in found], "feature string, cut double")
    return out.select("feature", rnd("cut").alias("cut"))


def _lime(v):
    m, train, test = _fitted(v)
    return EX.lime_local(test, train, FEATURES, {0: EX.pipeline_scorer(m, 0), 1: EX.pipeline_scorer(m, 1)}, label="label")


@query("ex_lime_local", "EX3")
def ex_lime_local(v):
    return _lime(v)


@query("ex_lime_regression", "EX3")
def ex_lime_regression(v):
    split = SA.train_test_split(v.order_regression).persist()
    train, test = split.where("split = 'train'"), split.where("split = 'test'")
    m = ML.fit_model(train, "LR", "regression", FEATURES)
    return EX.lime_local(test, train, FEATURES, EX.pipeline_scorer(m, None))


@query("ex_lime_global_fitted", "EX3,EX4")
def ex_lime_global_fitted(v):
    return EX.lime_global(_lime(v))


@query("ex_tree_shapley", "EX6")
def ex_tree_shapley(v):
    from lucerna.operators.treeshap import tree_shapley
    m, train, test = _fitted(v, "RF")
    return tree_shapley(test, train, m, FEATURES)


@query("ex_tree_shapley_global", "EX6,EX7,ML4")
def ex_tree_shapley_global(v):
    from lucerna.operators.treeshap import tree_shapley
    m, train, test = _fitted(v, "XGBOOST", few=True)  # every level of every tree is two short stages over all partitions
    return EX.shapley_global(tree_shapley(test, train, m, FEATURES))


@query("ex_sampled_shapley", "EX6,EX7")
def ex_sampled_shapley(v):
    m, train, test = _fitted(v, "RF")
    loc = EX.sampled_shapley(test, train, FEATURES, EX.pipeline_scorer(m, 1))
    return EX.shapley_global(loc)


@query("ex_learning_curve", "EX17")
def ex_learning_curve(v):
    _, train, test = _fitted(v)
    return EX.learning_curve(train, test, FEATURES, "DT")
