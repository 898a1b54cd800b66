"""Queries for encoding (EN), profiling (PR) and normalisation (N)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lucerna.functions.exprs import rnd
from lucerna.operators import prep as P
from lucerna.operators import profile as PR
from lucerna.operators import scale as S
from lucerna.plans.catalog import query
from lucerna.plans.fixtures import FEATURES
from lucerna.plans.oracle_views import R, with_views

_PART_COLS = ["brand", "size", "price", "made", "empty", "const", "target"]


# ---------------------------------------------------------------- encoder

@query("en_drop_empty_columns", "EN1", with_views(
    "SELECT id, brand, size, price, made, const, target FROM part_raw", "part_raw"))
def en_drop_empty_columns(v):
    return P.drop_empty_columns(v.part_raw)


@query("en_drop_empty_rows", "EN2", with_views(
    "SELECT * FROM part_raw WHERE NOT (" + " AND ".join(f"{c} IS NULL" for c in _PART_COLS) + ")",
    "part_raw"))
def en_drop_empty_rows(v):
    return P.drop_empty_rows(v.part_raw, subset=_PART_COLS)


@query("en_drop_null_ratio", "EN3", with_views(
    "SELECT id, brand, price, made, const, target FROM part_raw", "part_raw"))
def en_drop_null_ratio(v):
    return P.drop_by_null_ratio(v.part_raw, ratio=8.0, keep=["id", "target"])


@query("en_drop_low_variance", "EN4", with_views(
    "SELECT id, brand, size, price, made, empty, target FROM part_raw", "part_raw"))
def en_drop_low_variance(v):
    return P.drop_by_variance(v.part_raw, 0.0, keep=["id", "target"])


def _is_date_sql(c):
    return (f"SELECT '{c}' AS \"column\", coalesce(min(CASE WHEN {c} IS NULL THEN NULL "
            f"WHEN try_strptime({c}, '%m/%d/%Y') IS NULL THEN 0 ELSE 1 END) = 1, false) AS is_date "
            f"FROM part_raw")


@query("en_date_columns", "EN5", with_views(
    " UNION ALL ".join(_is_date_sql(c) for c in ["brand", "made", "target"]), "part_raw"))
def en_date_columns(v):
    return P.date_columns(v.part_raw)


@query("en_encode_date", "EN6", with_views(
    "SELECT id, CAST(epoch(strptime(made, '%m/%d/%Y')) AS DOUBLE) AS made FROM part_raw", "part_raw"))
def en_encode_date(v):
    return P.encode_date(v.part_raw, "made").select("id", "made")


_BRANDS = [f"brand_{b}" for b in (*(f"Brand#{i}" for i in range(1, 26)), "nan")]
_ONE_HOT = ("SELECT id, " + ", ".join(f"count(*) FILTER (WHERE k = '{b}') AS \"{b}\"" for b in _BRANDS)
            + " FROM (SELECT id, 'brand_' || coalesce(brand, 'nan') AS k FROM part_raw) b GROUP BY id")


@query("en_one_hot", "EN7", with_views(f"SELECT * FROM ({_ONE_HOT}) p", "part_raw"))
def en_one_hot(v):
    return P.one_hot(v.part_raw.select("id", "brand"), "brand")


@query("en_encode_target", "EN8", with_views(
    "SELECT id, CAST(dense_rank() OVER (ORDER BY target) - 1 AS INTEGER) AS target "
    "FROM part_raw WHERE target IS NOT NULL", "part_raw"))
def en_encode_target(v):
    return P.encode_target(v.part_raw.select("id", "target"), "target")


@query("en_impute_mean", "EN9", with_views(f"""
SELECT id, {R("coalesce(size, (SELECT avg(size) FROM part_raw))")} AS size,
       {R("coalesce(price, (SELECT avg(price) FROM part_raw))")} AS price,
       empty, {R("coalesce(const, (SELECT avg(const) FROM part_raw))")} AS const
FROM part_raw""", "part_raw"))
def en_impute_mean(v):
    df = P.impute_mean(v.part_raw.select("id", "size", "price", "empty", "const"),
                       ["size", "price", "empty", "const"])
    return df.select("id", rnd("size").alias("size"), rnd("price").alias("price"), "empty",
                     rnd("const").alias("const"))


@query("en_encode_pipeline", "EN10", with_views(f"""
SELECT * FROM (WITH b AS (SELECT id, price, CAST(epoch(strptime(made, '%m/%d/%Y')) AS DOUBLE) AS made,
                        brand, target FROM part_raw),
     t AS (SELECT id, price, made, CAST(dense_rank() OVER (ORDER BY target) - 1 AS INTEGER) AS target
           FROM b WHERE target IS NOT NULL),
     ohd AS ({_ONE_HOT})
SELECT t.id, {R("coalesce(t.price, (SELECT avg(price) FROM t))")} AS price,
       {R("coalesce(t.made, (SELECT avg(made) FROM t))")} AS made,
       {", ".join(f'CAST("{b}" AS DOUBLE) AS "{b}"' for b in _BRANDS)}, t.target
FROM t JOIN ohd ON t.id = ohd.id) q""", "part_raw"))
def en_encode_pipeline(v):
    out = P.encode_table(v.part_raw, "id", "target", ratio_null=8.0)
    return out.select(*[rnd(c).alias(c) if c in ("price", "made") else F.col(c) for c in out.columns])


# ---------------------------------------------------------------- profiling

_ALL = FEATURES + ["label"]


def _corr_pairs_sql(cols):
    parts = []
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            parts.append(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {R(f'corr({a}, {b})')} AS corr FROM order_regression")
            parts.append(f"SELECT '{b}', '{a}', {R(f'corr({a}, {b})')} FROM order_regression")
    for c in cols:
        parts.append(f"SELECT '{c}', '{c}', 1.0")
    return " UNION ALL ".join(parts)


@query("pr_correlation_matrix", "PR1", with_views(_corr_pairs_sql(_ALL), "order_regression"))
def pr_correlation_matrix(v):
    return PR.correlation_long(v.order_regression, _ALL)


_POS = "CASE " + " ".join(f"WHEN {{c}} = '{c}' THEN {i}" for i, c in enumerate(_ALL)) + " END"


@query("pr_top_correlated_pairs", "PR2", with_views(f"""
SELECT feature_a, feature_b, corr, rank FROM (
  SELECT *, CAST(row_number() OVER (ORDER BY abs(corr) DESC, {_POS.format(c='feature_a')},
                                    {_POS.format(c='feature_b')}) AS BIGINT) AS rank
  FROM ({_corr_pairs_sql(_ALL)}) c
  WHERE {_POS.format(c='feature_a')} < {_POS.format(c='feature_b')}) r WHERE rank <= 10""",
    "order_regression"))
def pr_top_correlated_pairs(v):
    return PR.top_correlated_pairs(v.order_regression, _ALL, 10)


@query("pr_box_statistics", "PR3", with_views(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, {R(f'min({c})')} AS min, {R(f'quantile_cont({c}, 0.25)')} AS q1, "
    f"{R(f'quantile_cont({c}, 0.5)')} AS median, {R(f'quantile_cont({c}, 0.75)')} AS q3, "
    f"{R(f'max({c})')} AS max FROM order_regression" for c in _ALL), "order_regression"))
def pr_box_statistics(v):
    return PR.box_statistics(v.order_regression, _ALL)


@query("pr_trend_lines", "PR4", with_views(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, {R(f'regr_slope(label, {c})')} AS slope, "
    f"{R(f'regr_intercept(label, {c})')} AS intercept FROM order_regression" for c in FEATURES),
    "order_regression"))
def pr_trend_lines(v):
    return PR.trend_lines(v.order_regression, FEATURES, "label")


@query("pr_feature_density", "PR6", with_views("""
SELECT CAST(CASE WHEN mx = mn THEN 0 ELSE least(floor((CAST(n_lines AS DOUBLE) - mn) / (mx - mn) * 20), 19) END
            AS INTEGER) AS bin, label, COUNT(*) AS n
FROM order_binary, (SELECT CAST(min(n_lines) AS DOUBLE) AS mn, CAST(max(n_lines) AS DOUBLE) AS mx
                    FROM order_binary) s GROUP BY 1, 2""", "order_binary"))
def pr_feature_density(v):
    return PR.feature_target_density(v.order_binary, "n_lines", "label", 20)


# ---------------------------------------------------------------- normalisation

def _wide_sql(exprs: dict[str, str], src="order_features", extra_from="") -> str:
    cols = ", ".join(f"{R(e)} AS {c}" for c, e in exprs.items())
    return f"SELECT id, {cols} FROM {src}{extra_from}"


def _stat(fn, c):
    return f"(SELECT {fn}(CAST({c} AS DOUBLE)) FROM order_features)"


def _sc(c):
    return f"((CAST({c} AS DOUBLE) - {_stat('avg', c)}) / coalesce(nullif({_stat('stddev_pop', c)}, 0), 1.0))"


def _mm(c, x=None):
    x = x or f"CAST({c} AS DOUBLE)"
    return (f"(({x} - {_stat('min', c)}) / coalesce(nullif({_stat('max', c)} - {_stat('min', c)}, 0), 1.0))")


def _ma(c):
    return (f"(CAST({c} AS DOUBLE) / coalesce(nullif(greatest(abs({_stat('min', c)}), "
            f"abs({_stat('max', c)})), 0), 1.0))")


def _scaled(v, methods):
    df = S.normalise(v.order_features.select("id", *FEATURES), FEATURES, methods, "id")
    return df.select("id", *[rnd(c).alias(c) for c in FEATURES])


@query("n_standard", "N1", with_views(_wide_sql({c: _sc(c) for c in FEATURES}), "order_features"))
def n_standard(v):
    return _scaled(v, "SC")


@query("n_min_max", "N2", with_views(_wide_sql({c: _mm(c) for c in FEATURES}), "order_features"))
def n_min_max(v):
    return _scaled(v, "MM")


@query("n_max_abs", "N3", with_views(_wide_sql({c: _ma(c) for c in FEATURES}), "order_features"))
def n_max_abs(v):
    return _scaled(v, "MA")


@query("n_quantile_uniform", "N4", with_views(_wide_sql({
    c: f"(percent_rank() OVER (ORDER BY {c}) + 1.0 - percent_rank() OVER (ORDER BY {c} DESC)) / 2.0"
    for c in FEATURES}), "order_features"))
def n_quantile_uniform(v):
    return _scaled(v, "QT")


@query("n_box_cox", "N5")
def n_box_cox(v):
    cols = ["sum_qty", "total_price", "n_lines"]
    out, _ = S.power_transform(v.order_features.select("id", *cols), cols, "BC")
    return out


@query("n_yeo_johnson", "N6")
def n_yeo_johnson(v):
    out, _ = S.power_transform(v.order_features.select("id", *FEATURES), FEATURES, "YJ")
    return out


_NORM = "sqrt(" + " + ".join(f"CAST({c} AS DOUBLE) * CAST({c} AS DOUBLE)" for c in FEATURES) + ")"


@query("n_l2_rows", "N7", with_views(_wide_sql(
    {c: f"CAST({c} AS DOUBLE) / (CASE WHEN {_NORM} = 0 THEN 1.0 ELSE {_NORM} END)" for c in FEATURES}),
    "order_features"))
def n_l2_rows(v):
    return _scaled(v, "NE")


@query("n_binarize", "N8", with_views(_wide_sql(
    {c: f"CASE WHEN {R(c, 12)} > 0.5 THEN 1.0 ELSE 0.0 END" for c in FEATURES}), "order_features"))
def n_binarize(v):
    return _scaled(v, "BI")


_PF_COLS = ["n_lines", "sum_qty", "avg_disc"]


def _pf_sql():
    exprs = {'"1"': "1.0"}
    for c in _PF_COLS:
        exprs[c] = f"CAST({c} AS DOUBLE)"
    for i, a in enumerate(_PF_COLS):
        for b in _PF_COLS[i:]:
            exprs['"' + (f"{a}^2" if a == b else f"{a} {b}") + '"'] = f"CAST({a} AS DOUBLE) * CAST({b} AS DOUBLE)"
    return "SELECT id, " + ", ".join(f"{R(e)} AS {c}" for c, e in exprs.items()) + " FROM order_features"


@query("n_polynomial", "N9", with_views(_pf_sql(), "order_features"))
def n_polynomial(v):
    df = S.polynomial_features(v.order_features.select("id", *_PF_COLS), _PF_COLS)
    return df.select("id", *[rnd(F.col(f"`{c}`")).alias(c) for c in df.columns if c != "id"])


def _smm_sql(final_bi=False):
    s1 = "SELECT id, " + ", ".join(f"{_sc(c)} AS {c}" for c in FEATURES) + " FROM order_features"
    def mm(c):
        x = (f"(({c} - (SELECT min({c}) FROM s1)) / coalesce(nullif((SELECT max({c}) FROM s1) - "
             f"(SELECT min({c}) FROM s1), 0), 1.0))")
        return f"CASE WHEN {R(x, 12)} > 0.5 THEN 1.0 ELSE 0.0 END" if final_bi else x
    return ("SELECT * FROM (WITH s1 AS (" + s1 + ") SELECT id, " +
            ", ".join(f"{R(mm(c))} AS {c}" for c in FEATURES) + " FROM s1) q")


def _sma_sql():
    s1 = "SELECT id, " + ", ".join(f"{_sc(c)} AS {c}" for c in FEATURES) + " FROM order_features"
    def ma(c):
        return (f"({c} / coalesce(nullif(greatest(abs((SELECT min({c}) FROM s1)), "
                f"abs((SELECT max({c}) FROM s1))), 0), 1.0))")
    return ("SELECT * FROM (WITH s1 AS (" + s1 + ") SELECT id, " +
            ", ".join(f"{R(ma(c))} AS {c}" for c in FEATURES) + " FROM s1) q")


@query("n_chain_smm", "N10", with_views(_smm_sql(), "order_features"))
def n_chain_smm(v):
    return _scaled(v, "SMM")


@query("n_chain_smb", "N11", with_views(_smm_sql(final_bi=True), "order_features"))
def n_chain_smb(v):
    return _scaled(v, "SMB")


@query("n_chain_sma", "N12", with_views(_sma_sql(), "order_features"))
def n_chain_sma(v):
    return _scaled(v, "SMA")
