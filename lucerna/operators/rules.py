"""RL1-RL4 and ML18/ML19: rule tables.

Rule text (RIPPER style: rules separated by ``V``, conditions by ``^``,
conditions ``<index><op><value>`` or ``<index>=<lo>-<hi>``) is parsed with
``split`` / ``explode`` / ``regexp_extract`` into a predicates table
``source, rule_no, cond_no, feature, op, value``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lucerna.functions.exprs import rnd

STRICT_SHIFT = 1e-5  # fixed: strict bounds become closed bounds moved by this much
# fixed: the form of one condition, numbers with or without an exponent
_NUMBER = r"-?[0-9.]+(?:[eE][+-]?[0-9]+)?"
_COND = rf"^\s*([A-Za-z_][A-Za-z0-9_ ]*|[0-9]+)\s*(=>|>=|=<|<=|=|<|>)\s*({_NUMBER})(-({_NUMBER}))?\s*$"


def lime_rules(lime_rows: DataFrame, top: int = 10) -> DataFrame:
    """RL1: per (class, range): count, mean weight, coeff = count x mean; top ``top``
    per class by |coeff| (ties by range text)."""
    g = lime_rows.groupBy("class", "range").agg(F.count(F.lit(1)).alias("count"),
                                                 F.avg("attribution").alias("mean_weight"))
    g = g.withColumn("coeff", F.col("count") * F.col("mean_weight"))
    # one row per (class, range): bounded by classes x distinct range texts
    w = Window.partitionBy("class").orderBy(F.abs("coeff").desc(), F.col("range"))
    return g.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top).drop("_r")


def parse_rules(text: DataFrame, feature_names: Sequence[str], text_col: str = "text",
                source_col: str = "source") -> DataFrame:
    """RL2: rule text -> predicates.  Column indexes and ``feature_<i>`` become
    names; ``=>`` / ``=<`` are repaired; ``i=lo-hi`` becomes two predicates."""
    names = F.array(*[F.lit(n) for n in feature_names])
    rules = (text.select(source_col, F.posexplode(F.split(F.col(text_col), r"\s+V\s+")).alias("rule_no", "_r"))
             .select(source_col, "rule_no", F.regexp_replace("_r", r"[\[\]]", "").alias("_r")))
    conds = (rules.select(source_col, "rule_no",
                          F.posexplode(F.split(F.regexp_replace("_r", r"\s+and\s+", "^"), r"\^")).alias("cond_no", "_c"))
             .select(source_col, "rule_no", "cond_no",
                     F.regexp_replace("_c", r"feature_([0-9]+)", "$1").alias("_c")))
    key = F.regexp_extract("_c", _COND, 1)
    op = F.regexp_extract("_c", _COND, 2)
    v1 = F.regexp_extract("_c", _COND, 3)
    v2 = F.regexp_extract("_c", _COND, 5)
    feat = F.when(key.rlike(r"^[0-9]+$"),
                  F.coalesce(F.element_at(names, key.cast("int") + 1), F.concat(F.lit("F"), key))).otherwise(F.trim(key))
    op = F.when(op == "=>", ">=").when(op == "=<", "<=").otherwise(op)
    base = conds.select(source_col, "rule_no", "cond_no", feat.alias("feature"), op.alias("op"),
                        v1.cast("double").alias("v1"), F.when(v2 != "", v2.cast("double")).alias("v2"))
    is_range = (F.col("op") == "=") & F.col("v2").isNotNull()
    preds = F.when(is_range, F.array(F.struct(F.lit(">=").alias("op"), F.col("v1").alias("value")),
                                     F.struct(F.lit("<=").alias("op"), F.col("v2").alias("value")))
                   ).otherwise(F.array(F.struct(F.col("op").alias("op"), F.col("v1").alias("value"))))
    return (base.select(source_col, "rule_no", "cond_no", "feature", F.explode(preds).alias("p"))
            .select(source_col, "rule_no", "cond_no", "feature", "p.op", "p.value"))


def rule_text(preds: DataFrame, source_col: str = "source") -> DataFrame:
    """ML19: one row per rule, ``feature op value and ...`` (value with 2 decimals)."""
    cond = F.concat(F.col("feature"), F.lit(" "), F.col("op"), F.lit(" "),
                    F.format_string("%.2f", rnd("value", 2)))
    return (preds.groupBy(source_col, "rule_no")
            .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("cond_no", "op", cond.alias("t")))),
                                          lambda s: s["t"]), " and ").alias("rule")))


def _pred_col(feature: str, op: str, value: float) -> Column:
    x = F.col(f"`{feature}`").cast("double")
    return {">=": x >= value, "<=": x <= value, ">": x > value, "<": x < value, "=": x == value}[op]


def apply_rules(df: DataFrame, preds: DataFrame, coefs: dict[int, float], positive=1, negative=0,
                id_col: str = "id", label: str = "label") -> tuple[DataFrame, DataFrame]:
    """RL3: rules tried in order; coef 0 skipped; first hit decides (coef > 0 ->
    positive class, < 0 -> negative); no hit -> negative.

    The rule set (bounded: tens of rules) is read once and compiled into one
    ``when`` chain.  Returns (per-row predictions, per-rule support/precision).
    """
    rows = preds.orderBy("rule_no", "cond_no").collect()
    rules: dict[int, list] = {}
    for r in rows:
        rules.setdefault(r["rule_no"], []).append(_pred_col(r["feature"], r["op"], r["value"]))
    hit = F.lit(None).cast("int")
    chain = None
    for rn in sorted(rules, reverse=True):   # build from the last rule outwards
        c = coefs.get(rn, 0.0)
        if c == 0:
            continue
        cond = rules[rn][0]
        for x in rules[rn][1:]:
            cond = cond & x
        hit = F.when(cond, F.lit(rn)).otherwise(hit)
    scored = df.withColumn("rule_no", hit)
    cmap = F.create_map(*[x for k, v in coefs.items() for x in (F.lit(k), F.lit(float(v)))])
    pred = F.when(F.col("rule_no").isNull(), negative).when(cmap[F.col("rule_no")] > 0, positive).otherwise(negative)
    scored = scored.withColumn("prediction", pred)
    stats = (scored.where(F.col("rule_no").isNotNull()).groupBy("rule_no")
             .agg(F.count(F.lit(1)).alias("support"),
                  F.avg(F.when(F.col(label) == F.col("prediction"), 1.0).otherwise(0.0)).alias("precision")))
    return scored.select(id_col, "rule_no", "prediction"), stats


def rule_intervals(preds: DataFrame, source_col: str = "source") -> DataFrame:
    """Per (rule, feature): the interval [lo, hi] its predicates allow
    (null = open end; strict bounds moved by 1e-5)."""
    v = F.col("value")
    lo = F.when(F.col("op") == ">=", v).when(F.col("op") == ">", v + STRICT_SHIFT).when(F.col("op") == "=", v)
    hi = F.when(F.col("op") == "<=", v).when(F.col("op") == "<", v - STRICT_SHIFT).when(F.col("op") == "=", v)
    return preds.groupBy(source_col, "rule_no", "feature").agg(F.max(lo).alias("lo"), F.min(hi).alias("hi"))


def merge_ranges(intervals: DataFrame) -> DataFrame:
    """RL4: per feature, merge overlapping or touching intervals (gaps and islands).

    Sorted by (lo nulls first, hi); an interval opens a new island when its lo
    is above the running max of the previous his (null = infinity).  Output:
    feature, lo, hi (null = open) and the rule text ``c >= lo AND c <= hi``.
    """
    inf = float("inf")
    lo = F.coalesce(F.col("lo"), F.lit(-inf))
    hi = F.coalesce(F.col("hi"), F.lit(inf))
    order = Window.partitionBy("feature").orderBy(lo, hi)
    prev_max = F.max(hi).over(order.rowsBetween(Window.unboundedPreceding, -1))
    x = intervals.withColumn("_lo", lo).withColumn("_hi", hi)
    x = x.withColumn("_new", F.when(prev_max.isNull() | (F.col("_lo") > prev_max), 1).otherwise(0))
    x = x.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    m = x.groupBy("feature", "_island").agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    lo_t = F.when(F.col("_lo") == -inf, None).otherwise(F.col("_lo"))
    hi_t = F.when(F.col("_hi") == inf, None).otherwise(F.col("_hi"))
    f1 = lambda c: F.format_string("%.1f", rnd(c, 1))
    text = (F.when(lo_t.isNull() & hi_t.isNotNull(), F.concat(F.col("feature"), F.lit(" <= "), f1(hi_t)))
            .when(lo_t.isNotNull() & hi_t.isNull(), F.concat(F.col("feature"), F.lit(" >= "), f1(lo_t)))
            .when(lo_t.isNotNull() & hi_t.isNotNull(),
                  F.concat(F.col("feature"), F.lit(" >= "), f1(lo_t), F.lit(" AND "), F.col("feature"),
                           F.lit(" <= "), f1(hi_t)))
            .otherwise(F.concat(F.col("feature"), F.lit(" (always true)"))))
    return m.select("feature", F.col("_island").cast("long").alias("island"), lo_t.alias("lo"),
                    hi_t.alias("hi"), text.alias("rule"))


def rulefit_table(rules: DataFrame, feature_names: Sequence[str]) -> DataFrame:
    """ML18: keep coef != 0, sorted by support desc, feature_<i> replaced by names."""
    out = rules.where(F.col("coef") != 0)
    txt = F.col("rule")
    for i, n in sorted(enumerate(feature_names), key=lambda t: -t[0]):   # feature_12 before feature_1
        txt = F.regexp_replace(txt, f"feature_{i}\\b", n)
    return out.withColumn("rule", txt).orderBy(F.col("support").desc())
