"""The fixture views of :mod:`lucerna.plans.fixtures` as DuckDB SQL.

``with_views(body, *names)`` prefixes a query with the CTEs it needs
(dependencies included, in order).  ``R(x, d)`` is the shared rounding rule.
"""

from __future__ import annotations

from lucerna.plans.fixtures import (BINARY_CUT, FEATURES, GLOBAL_METHODS, LOCAL_METHODS,
                                    MULTI_CUTS, attribution_weights)


def R(x: str, d: int = 6) -> str:
    """floor(x * 10^d + 0.5) / 10^d, identical to lucerna.functions.exprs.rnd."""
    s = f"{float(10 ** d)!r}"
    return f"(floor(({x}) * {s} + 0.5) / {s})"


def U(key: str, seed) -> str:
    """H1 uniform of (key, seed)."""
    return (f"(CAST(('0x' || substr(md5(CAST({key} AS VARCHAR) || '-' || '{seed}'), 1, 8)) AS BIGINT)"
            f" / 4294967296.0)")


def H(key: str, seed) -> str:
    """H1 order key (md5 hex) of (key, seed)."""
    return f"md5(CAST({key} AS VARCHAR) || '-' || '{seed}')"


_F = ", ".join(FEATURES)
_LOGIT = "(1.0 / (1.0 + exp(-({z}))))"
_Z = "((sum_qty - 100.0) / 25.0 + (CAST(n_lines AS DOUBLE) - 4.0) * 0.25)"

VIEWS: dict[str, tuple[list[str], str]] = {}


def _v(name, deps, sql):
    VIEWS[name] = (deps, sql)


_v("order_features", [], """
SELECT o.o_orderkey AS id, a.n_lines, a.sum_qty,
       a._sum_disc / CAST(a.n_lines AS DOUBLE) AS avg_disc,
       a.sum_tax, a.n_returned, o.o_totalprice AS total_price, a.sum_price
FROM (SELECT l_orderkey, COUNT(*) AS n_lines,
             CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty,
             CAST(SUM(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) AS _sum_disc,
             CAST(SUM(CAST(l_tax AS DECIMAL(18,2))) AS DOUBLE) AS sum_tax,
             CAST(SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS n_returned,
             CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_price
      FROM lineitem GROUP BY l_orderkey) a
JOIN orders o ON a.l_orderkey = o.o_orderkey""")

_v("order_binary", ["order_features"], f"""
SELECT id, {_F}, CASE WHEN sum_price > {BINARY_CUT} THEN 1 ELSE 0 END AS label FROM order_features""")

_v("order_multi", ["order_features"], f"""
SELECT id, {_F}, CASE WHEN sum_price >= {MULTI_CUTS[1]} THEN 2 WHEN sum_price >= {MULTI_CUTS[0]} THEN 1
                 ELSE 0 END AS label FROM order_features""")

_v("order_regression", ["order_features"], f"""
SELECT id, {_F}, sum_price AS label FROM order_features""")

_v("order_pred", ["order_binary"], f"""
SELECT id, label, probability, CASE WHEN probability >= 0.5 THEN 1 ELSE 0 END AS prediction
FROM (SELECT id, label, {R(_LOGIT.format(z=_Z))} AS probability FROM order_binary) t""")

_v("order_pred_multi", ["order_multi"], f"""
SELECT id, label,
       {R('exp(-z) / (exp(-z) + exp(0.5) + exp(z))')} AS p0,
       {R('exp(0.5) / (exp(-z) + exp(0.5) + exp(z))')} AS p1,
       {R('exp(z) / (exp(-z) + exp(0.5) + exp(z))')} AS p2,
       CASE WHEN z > 0.5 THEN 2 WHEN z > -0.5 THEN 1 ELSE 0 END AS prediction
FROM (SELECT id, label, {_Z} AS z FROM order_multi) t""")

_v("order_pred_reg", ["order_regression"], """
SELECT id, label, sum_qty * 1900.0 + CAST(n_lines AS DOUBLE) * 5000.0 AS prediction FROM order_regression""")

_VOTE_Z = {
    "lines": "(CAST(n_lines AS DOUBLE) - 4.0) / 1.5",
    "price": "(total_price - 250000.0) / 125000.0",
    "qty": "(sum_qty - 96.0) / 40.0",
    "tax": "(sum_tax - 0.15) / 0.08",
}
_v("model_votes", ["order_binary"], "\nUNION ALL\n".join(
    f"SELECT id, label, '{m}' AS model, probability, "
    f"CASE WHEN probability >= 0.5 THEN 1 ELSE 0 END AS prediction "
    f"FROM (SELECT id, label, {R(_LOGIT.format(z=z))} AS probability FROM order_binary) t_{m}"
    for m, z in _VOTE_Z.items()))


def binary_metrics_sql(src: str, group: list[str], label="label", pred="prediction") -> str:
    """EV20 binary bundle as SQL over ``src`` (long: group..., metric, value)."""
    g = ", ".join(group)
    gsel = (g + ", ") if g else ""
    gby = f"GROUP BY {g}" if g else ""

    def sdiv(a, b):
        return f"(CASE WHEN ({b}) = 0 THEN 0.0 ELSE ({a}) / ({b}) END)"
    tp, tn, fp, fn = "tp", "tn", "fp", "fn"
    metrics = {
        "Accuracy": R(f"100.0 * {sdiv('tp + tn', 'tp + tn + fp + fn')}", 3),
        "Precision": R(f"100.0 * {sdiv('tp', 'tp + fp')}", 3),
        "F1": R(f"100.0 * {sdiv('2.0 * tp', '2.0 * tp + fp + fn')}", 3),
        "Recall": R(f"100.0 * {sdiv('tp', 'tp + fn')}", 3),
        "Specificity": R(f"100.0 * {sdiv('tn', 'tn + fp')}", 3),
        "Auc": f"CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN "
               f"{R(f'({sdiv(tp, 'tp + fn')} + {sdiv(tn, 'tn + fp')}) / 2.0', 3)} END",
        "MCC": R(sdiv("tp * tn - fp * fn", "sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))"), 3),
    }
    counts = (f"SELECT {gsel}"
              f"CAST(SUM(CASE WHEN {label} = 0 AND {pred} = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS tn, "
              f"CAST(SUM(CASE WHEN {label} = 0 AND {pred} = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS fp, "
              f"CAST(SUM(CASE WHEN {label} = 1 AND {pred} = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS fn, "
              f"CAST(SUM(CASE WHEN {label} = 1 AND {pred} = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS tp "
              f"FROM {src} {gby}")
    parts = [f"SELECT {gsel}'{k}' AS metric, CAST({v} AS DOUBLE) AS value FROM c" for k, v in metrics.items()]
    return f"(WITH c AS ({counts}) " + " UNION ALL ".join(parts) + ")"


_v("run_metrics", ["model_votes"], f"""
SELECT model || '_1' AS run, model, metric, value FROM {binary_metrics_sql('model_votes', ['model'])} m""")

_v("doc_quality", [], """
SELECT d.doc_id AS id, CAST(d.n_chars AS DOUBLE) AS n_chars,
       CAST(len(string_split(d.text, ' ')) AS DOUBLE) AS n_tokens,
       CAST(length(d.text) - length(regexp_replace(d.text, '[0-9]', '', 'g')) AS DOUBLE) AS n_digits,
       l.quality AS label
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")

_v("emb_points", [], "SELECT vec_id AS id, " + ", ".join(
    f"CAST(embedding[{i + 1}] AS DOUBLE) AS e{i}" for i in range(64)) + ", label FROM embeddings")

_UP = U("p_partkey", 7)
_v("part_raw", [], f"""
SELECT p_partkey AS id,
       CASE WHEN {_UP} < 0.02 THEN NULL ELSE p_brand END AS brand,
       CASE WHEN {_UP} < 0.02 OR {_UP} < 0.10 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS size,
       CASE WHEN {_UP} < 0.02 THEN NULL ELSE p_retailprice END AS price,
       CASE WHEN {_UP} < 0.02 OR {_UP} < 0.05 THEN NULL
            ELSE strftime(DATE '2020-01-01' + CAST(p_partkey % 1000 AS INTEGER), '%m/%d/%Y') END AS made,
       CAST(NULL AS DOUBLE) AS empty,
       CASE WHEN {_UP} < 0.02 THEN NULL ELSE 1.0 END AS const,
       CASE WHEN {_UP} < 0.02 OR {_UP} > 0.97 THEN NULL ELSE p_type END AS target
FROM part""")

_v("standardised", ["order_features"], "SELECT l.id, l.feature, (l.x - s.mu) / CASE WHEN s.sd = 0 THEN 1.0 ELSE s.sd END AS z FROM (" + " UNION ALL ".join(
    f"SELECT id, '{f}' AS feature, CAST({f} AS DOUBLE) AS x FROM order_features" for f in FEATURES)
   + ") l JOIN (" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, avg(CAST({f} AS DOUBLE)) AS mu, stddev_pop(CAST({f} AS DOUBLE)) AS sd FROM order_features"
    for f in FEATURES) + ") s ON l.feature = s.feature")

_v("attr_weights", [], "SELECT * FROM (VALUES " + ", ".join(
    f"('{m}', '{k}', '{f}', {w!r})" for (m, k, f), w in attribution_weights().items())
   + ") t(model, method, feature, weight)")

_LM = ", ".join(f"'{m}'" for m in LOCAL_METHODS)
_GM = ", ".join(f"'{m}'" for m in GLOBAL_METHODS)
_v("attributions", ["standardised", "attr_weights", "order_pred"], f"""
SELECT w.model, w.method, CAST(z.id AS BIGINT) AS sample_id, z.feature,
       {R('z.z * w.weight')} AS attribution, p.probability
FROM standardised z JOIN attr_weights w ON z.feature = w.feature AND w.method IN ({_LM})
JOIN order_pred p ON z.id = p.id
UNION ALL
SELECT w.model, w.method, CAST(NULL AS BIGINT) AS sample_id, z.feature,
       {R('avg(abs(z.z * w.weight))')} AS attribution, CAST(NULL AS DOUBLE) AS probability
FROM standardised z JOIN attr_weights w ON z.feature = w.feature AND w.method IN ({_GM})
GROUP BY w.model, w.method, z.feature""")


def with_views(body: str, *names: str) -> str:
    """Prefix ``body`` with the CTEs of ``names`` and their dependencies."""
    order: list[str] = []

    def visit(n):
        if n in order:
            return
        for d in VIEWS[n][0]:
            visit(d)
        order.append(n)
    for n in names:
        visit(n)
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in order)
    return f"WITH {ctes}\n{body}"


def _fmt2(x: str) -> str:
    return f"printf('%.2f', {R(x, 2)})"


_v("feature_long", ["order_features"], " UNION ALL ".join(
    f"SELECT id, '{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM order_features" for f in FEATURES))

_v("lime_rows", ["feature_long", "attributions", "order_pred"], f"""
SELECT a.model, a.sample_id,
       CASE WHEN l.value <= q.q1 THEN l.feature || ' <= ' || {_fmt2('q.q1')}
            WHEN l.value <= q.q2 THEN {_fmt2('q.q1')} || ' < ' || l.feature || ' <= ' || {_fmt2('q.q2')}
            WHEN l.value <= q.q3 THEN {_fmt2('q.q2')} || ' < ' || l.feature || ' <= ' || {_fmt2('q.q3')}
            ELSE l.feature || ' > ' || {_fmt2('q.q3')} END AS range,
       a.attribution, p.prediction AS class, p.probability
FROM attributions a
JOIN feature_long l ON a.sample_id = l.id AND a.feature = l.feature
JOIN (SELECT feature, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2,
             quantile_cont(value, 0.75) AS q3 FROM feature_long GROUP BY feature) q ON l.feature = q.feature
JOIN order_pred p ON a.sample_id = p.id
WHERE a.method = 'LIME'""")

_v("brand_effects", [], f"""
SELECT p_brand AS feature, {R('avg(p_retailprice) - (SELECT avg(p_retailprice) FROM part)')} AS attribution
FROM part GROUP BY p_brand""")

_v("flag_brand_effects", [], f"""
SELECT *, CAST(row_number() OVER (PARTITION BY sample_id ORDER BY abs(attribution) DESC, feature) AS BIGINT) AS rank
FROM (SELECT l.l_returnflag AS sample_id, p.p_brand AS feature,
             {R('avg(l.l_extendedprice) - m.m')} AS attribution
      FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
      JOIN (SELECT l_returnflag, avg(l_extendedprice) AS m FROM lineitem GROUP BY 1) m
        ON l.l_returnflag = m.l_returnflag
      GROUP BY l.l_returnflag, p.p_brand, m.m) t""")

_v("model_quality", ["run_metrics"], """
SELECT CASE WHEN model = 'qty' THEN 'LR' ELSE 'RF' END AS model, value AS metric
FROM run_metrics WHERE metric = 'Auc' AND model IN ('qty', 'tax')""")

_v("ranked", ["attributions"], """
SELECT *, CAST(row_number() OVER (PARTITION BY model, method, sample_id
                                  ORDER BY attribution DESC, feature) AS BIGINT) AS ranking
FROM attributions""")

_v("rules_text", ["order_features"], f"""
SELECT source, '[1=' || {_fmt2('q_qty25')} || '-' || {_fmt2('q_qty75')} || '^0=>' || {_fmt2('q_lines50')}
               || '] V [3=<' || {_fmt2('q_tax25')} || ']' AS text
FROM (SELECT o.o_orderpriority AS source,
             quantile_cont(CAST(f.sum_qty AS DOUBLE), 0.25) AS q_qty25,
             quantile_cont(CAST(f.sum_qty AS DOUBLE), 0.75) AS q_qty75,
             quantile_cont(CAST(f.n_lines AS DOUBLE), 0.5) AS q_lines50,
             quantile_cont(CAST(f.sum_tax AS DOUBLE), 0.25) AS q_tax25
      FROM order_features f JOIN orders o ON f.id = o.o_orderkey GROUP BY 1) q""")

# rules_text parsed: the numbers are the printed 2-decimal values
_v("rule_preds", ["rules_text"], """
SELECT source, 0 AS rule_no, 0 AS cond_no, 'sum_qty' AS feature, '>=' AS op,
       CAST(regexp_extract(text, '^\\[1=([0-9.]+)-', 1) AS DOUBLE) AS value FROM rules_text
UNION ALL SELECT source, 0, 0, 'sum_qty', '<=', CAST(regexp_extract(text, '^\\[1=[0-9.]+-([0-9.]+)', 1) AS DOUBLE) FROM rules_text
UNION ALL SELECT source, 0, 1, 'n_lines', '>=', CAST(regexp_extract(text, '\\^0=>([0-9.]+)', 1) AS DOUBLE) FROM rules_text
UNION ALL SELECT source, 1, 0, 'sum_tax', '<=', CAST(regexp_extract(text, '3=<([0-9.]+)', 1) AS DOUBLE) FROM rules_text""")
