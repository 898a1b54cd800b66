"""Queries for the split (SP1), class balance (PR5), balancing (BA) and folds (CV)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lucerna.functions.exprs import rnd
from lucerna.operators import folds as CV
from lucerna.operators import profile as PR
from lucerna.operators import sample as SA
from lucerna.plans.catalog import query
from lucerna.plans.oracle_views import H, R, with_views

_DQ = ["n_chars", "n_tokens", "n_digits"]


def _split_sql(src: str, cols: str = "id, label") -> str:
    return (f"SELECT {cols}, CASE WHEN row_number() OVER (ORDER BY {H('id', 2020)}, id) "
            f"<= floor(count(*) OVER () * 0.8) THEN 'train' ELSE 'test' END AS split FROM {src}")


@query("sp_train_test_split", "SP1", with_views(_split_sql("order_binary"), "order_binary"))
def sp_train_test_split(v):
    return SA.train_test_split(v.order_binary.select("id", "label"))


@query("pr_class_balance", "PR5", with_views(f"""
SELECT split, label, COUNT(*) AS n,
       {R('100.0 * COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY split)', 2)} AS pct
FROM ({_split_sql('order_multi')}) s GROUP BY split, label""", "order_multi"))
def pr_class_balance(v):
    return PR.class_balance(SA.train_test_split(v.order_multi.select("id", "label")))


def _ros_sql(src: str) -> str:
    cols = ", ".join(["label"] + _DQ)
    return f"""
SELECT * FROM (WITH c AS (SELECT label, COUNT(*) AS nc FROM {src} GROUP BY label),
     info AS (SELECT label, nc, mx - nc AS m,
                     COALESCE(SUM(mx - nc) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING
                                                 AND 1 PRECEDING), 0) AS off
              FROM c, (SELECT max(nc) AS mx FROM c) t),
     r AS (SELECT s.*, row_number() OVER (PARTITION BY label ORDER BY {H('id', 2020)}, id) AS rn FROM {src} s),
     x AS (SELECT r.*, info.nc, info.m, info.off,
                  CAST(floor(info.m / info.nc) AS BIGINT)
                  + CASE WHEN rn <= info.m - floor(info.m / info.nc) * info.nc THEN 1 ELSE 0 END AS copies
           FROM r JOIN info ON r.label = info.label),
     e AS (SELECT x.*, unnest(generate_series(0, copies - 1)) AS copy FROM x WHERE copies > 0)
SELECT id, {cols}, false AS synthetic FROM {src}
UNION ALL
SELECT CAST(-(off + copy * nc + rn) AS BIGINT) AS id, {cols}, true AS synthetic FROM e) q"""


@query("ba_over_sample", "BA1,BA6", with_views(_ros_sql("doc_quality"), "doc_quality"))
def ba_over_sample(v):
    return SA.random_over_sample(v.doc_quality)


@query("ba_under_sample", "BA2", with_views(f"""
SELECT id, label, {', '.join(_DQ)} FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY {H('id', 2020)}, id) AS rn FROM doc_quality) r
WHERE rn <= (SELECT min(c) FROM (SELECT COUNT(*) AS c FROM doc_quality GROUP BY label) t)""",
    "doc_quality"))
def ba_under_sample(v):
    return SA.random_under_sample(v.doc_quality).select("id", "label", *_DQ)


@query("ba_class_weights", "BA5", with_views(f"""
SELECT id, label, {R('CAST((SELECT COUNT(*) FROM doc_quality) AS DOUBLE) / '
                     '((SELECT COUNT(DISTINCT label) FROM doc_quality) * '
                     'COUNT(*) OVER (PARTITION BY label))')} AS weight
FROM doc_quality""", "doc_quality"))
def ba_class_weights(v):
    out = SA.class_weights(v.doc_quality.select("id", "label"))
    return out.select("id", "label", rnd("weight").alias("weight"))


@query("ba_chain_train_ros_pen", "BA6,BA1,BA5", with_views(f"""
SELECT q.*, 1.0 AS weight FROM ({_ros_sql('tr')}) q""".replace(
    "WITH c AS", f"WITH tr AS (SELECT * FROM ({_split_sql('doc_quality', 'id, label, ' + ', '.join(_DQ))}) s "
                 f"WHERE split = 'train'), c AS"), "doc_quality"))
def ba_chain_train_ros_pen(v):
    tr = SA.train_test_split(v.doc_quality).where(F.col("split") == "train").drop("split")
    out = SA.balance(tr, ["ROS", "PEN"])
    return out.select(*[rnd(c).alias(c) if c == "weight" else F.col(c) for c in out.columns])


# ---------------------------------------------------------------- folds

@query("cv_kfold", "CV1", with_views("""
SELECT id, CAST(CASE WHEN r < rem * (q + 1) THEN r // (q + 1) ELSE rem + (r - rem * (q + 1)) // q END
                AS INTEGER) AS fold
FROM (SELECT id, row_number() OVER (ORDER BY id) - 1 AS r, count(*) OVER () // 5 AS q,
             count(*) OVER () % 5 AS rem FROM order_binary) t""", "order_binary"))
def cv_kfold(v):
    return CV.kfold(v.order_binary.select("id"))


def _strat_sql(seed_expr: str, extra: str = "") -> str:
    return (f"SELECT id, label, CAST((row_number() OVER (PARTITION BY label{extra} ORDER BY "
            f"md5(CAST(id AS VARCHAR) || '-' || {seed_expr}), id) - 1) % 5 AS INTEGER) AS fold")


@query("cv_stratified_kfold", "CV5", with_views(
    _strat_sql("'500'") + " FROM order_multi", "order_multi"))
def cv_stratified_kfold(v):
    return CV.stratified_kfold(v.order_multi.select("id", "label"))


@query("cv_repeated_stratified", "CV2", with_views(
    _strat_sql("'500-' || CAST(j.range AS VARCHAR)", ", j.range").replace(
        "SELECT id, label,", "SELECT id, label, CAST(j.range AS INTEGER) AS repeat,")
    + " FROM order_multi, range(10) j", "order_multi"))
def cv_repeated_stratified(v):
    return CV.repeated_stratified_kfold(v.order_multi.select("id", "label"))


@query("cv_leave_one_out", "CV3", with_views(
    "SELECT id, row_number() OVER (ORDER BY id) - 1 AS fold FROM order_binary", "order_binary"))
def cv_leave_one_out(v):
    return CV.leave_one_out(v.order_binary.select("id"))


@query("cv_shuffle_split", "CV4", with_views("""
SELECT id, CAST(j.range AS INTEGER) AS split_no,
       row_number() OVER (PARTITION BY j.range ORDER BY md5(CAST(id AS VARCHAR) || '-' || '500-'
                          || CAST(j.range AS VARCHAR)), id) <= ceil(0.1 * (SELECT COUNT(*) FROM order_binary))
       AS is_test
FROM order_binary, range(10) j""", "order_binary"))
def cv_shuffle_split(v):
    return CV.shuffle_split(v.order_binary.select("id"))


@query("cv_group_kfold", "CV6", with_views("""
SELECT * FROM (WITH g AS (SELECT id, CAST(floor(5.0 * (row_number() OVER (ORDER BY id) - 1)
                                          / (count(*) OVER () - 1)) AS INTEGER) AS "group" FROM order_binary),
     s AS (SELECT "group", COUNT(*) AS size FROM g GROUP BY 1),
     o AS (SELECT "group", size, row_number() OVER (ORDER BY size DESC, "group" DESC) AS p FROM s),
     m AS (SELECT "group", CASE WHEN p <= 5 THEN p - 1 ELSE
             (SELECT min(p) - 1 FROM o o2 WHERE o2.p <= 5
                AND o2.size = (SELECT min(size) FROM o o3 WHERE o3.p <= 5)) END AS fold FROM o)
SELECT g.id, g."group", CAST(m.fold AS INTEGER) AS fold FROM g JOIN m ON g."group" = m."group") q""",
    "order_binary"))
def cv_group_kfold(v):
    return CV.group_kfold(v.order_binary.select("id"))


# ---------------------------------------------------------------- neighbours

_E = [f"e{i}" for i in range(64)]
_DIST_SQL = "sqrt(" + " + ".join(f"(q.{c} - b.{c}) * (q.{c} - b.{c})" for c in _E) + ")"
_KNN_SQL = f"""
SELECT * FROM (WITH sp AS ({_split_sql('emb_points', 'id, label, ' + ', '.join(_E))}),
     q AS (SELECT * FROM sp WHERE split = 'test'), b AS (SELECT * FROM sp WHERE split = 'train'),
     pr AS (SELECT q.id AS qid, b.id AS nid, b.label AS y, {_DIST_SQL} AS dist FROM q, b),
     nn AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, nid) AS rank FROM pr)
{{select}}) t"""


def _emb_split(v):
    s = SA.train_test_split(v.emb_points)
    return s.where("split = 'train'"), s.where("split = 'test'")


@query("knn_neighbours", "H3", with_views(_KNN_SQL.format(
    select=f"SELECT qid, nid, {R('dist')} AS dist, CAST(rank AS INTEGER) AS rank FROM nn WHERE rank <= 5"),
    "emb_points"))
def knn_neighbours(v):
    from lucerna.operators.neighbours import knn
    train, test = _emb_split(v)
    out = knn(test, train, _E, 5)
    return out.select("qid", "nid", rnd("dist").alias("dist"), "rank")


@query("knn_pairs_met", "H3")
def knn_pairs_met(v):
    from lucerna.operators.neighbours import neighbour_pairs
    train, test = _emb_split(v)
    return neighbour_pairs(test, train, _E, 5)


@query("ml_knn_classifier", "ML6,H3", with_views(_KNN_SQL.format(select=f"""
, k AS (SELECT * FROM nn WHERE rank <= 5),
     z AS (SELECT *, min(dist) OVER (PARTITION BY qid) AS mind FROM k),
     wv AS (SELECT qid, y, sum(CASE WHEN mind = 0 THEN (CASE WHEN dist = 0 THEN 1.0 ELSE 0.0 END)
                                 ELSE 1.0 / dist END) AS cw FROM z GROUP BY 1, 2),
     r AS (SELECT *, cw / sum(cw) OVER (PARTITION BY qid) AS p,
                  row_number() OVER (PARTITION BY qid ORDER BY cw DESC, y) AS rr FROM wv)
SELECT qid AS id, y AS prediction, {R('p')} AS probability FROM r WHERE rr = 1""").replace(
    "nn AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, nid) AS rank FROM pr)\n,",
    "nn AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, nid) AS rank FROM pr),"),
    "emb_points"))
def ml_knn_classifier(v):
    from lucerna.operators.neighbours import knn, knn_predict
    train, test = _emb_split(v)
    out = knn_predict(knn(test, train, _E, 5), train)
    return out.select("id", "prediction", rnd("probability").alias("probability"))


@query("ba_smote", "BA3")
def ba_smote(v):
    from lucerna.operators.neighbours import smote
    return smote(v.doc_quality, _DQ)


@query("ba_adasyn", "BA4")
def ba_adasyn(v):
    from lucerna.operators.neighbours import adasyn
    return adasyn(v.doc_quality, _DQ)
