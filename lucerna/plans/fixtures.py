"""Modelling views derived from the driver tables (FIXTURES.md §3).

Each view is a plain DataFrame plan over the parquet tables, so Catalyst
prunes columns and the work grows with the tables.  ``lucerna.plans.oracle``
holds the same definitions as DuckDB SQL.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lucerna.functions.exprs import dec2, logistic, rnd, with_scalars
from lucerna.functions.hashing import hash_uniform
from lucerna.sources.tables import load

# Fixed values of the fixture definitions (shared with the SQL oracle).
FEATURES = ["n_lines", "sum_qty", "avg_disc", "sum_tax", "n_returned", "total_price"]
BINARY_CUT = 200000.0
MULTI_CUTS = (100000.0, 250000.0)
VOTE_MODELS = ["lines", "price", "qty", "tax"]


class Views:
    """Lazily built fixture views of one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._cache: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return load(self.spark, self.sf_dir, name)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        builder = globals().get(f"_{name}")
        if builder is None:
            raise AttributeError(name)
        if name not in self._cache:
            self._cache[name] = builder(self)
        return self._cache[name]


def _order_features(v: Views) -> DataFrame:
    # Aggregate lineitem to one row per order *before* the join: the join
    # then sees |orders| rows on both sides instead of |lineitem|.
    li = v.table("lineitem")
    agg = li.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum(dec2("l_quantity")).cast("double").alias("sum_qty"),
        F.sum(dec2("l_discount")).cast("double").alias("_sum_disc"),
        F.sum(dec2("l_tax")).cast("double").alias("sum_tax"),
        F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).cast("long").alias("n_returned"),
        F.sum(dec2("l_extendedprice")).cast("double").alias("sum_price"))
    o = v.table("orders").select(F.col("o_orderkey").alias("id"),
                                 F.col("o_totalprice").alias("total_price"))
    return (agg.join(o, agg["l_orderkey"] == o["id"])
            .select("id", "n_lines", "sum_qty",
                    (F.col("_sum_disc") / F.col("n_lines").cast("double")).alias("avg_disc"),
                    "sum_tax", "n_returned", "total_price", "sum_price"))


def _order_binary(v: Views) -> DataFrame:
    return v.order_features.select(
        "id", *FEATURES,
        F.when(F.col("sum_price") > BINARY_CUT, 1).otherwise(0).alias("label"))


def _order_multi(v: Views) -> DataFrame:
    lo, hi = MULTI_CUTS
    return v.order_features.select(
        "id", *FEATURES,
        F.when(F.col("sum_price") >= hi, 2).when(F.col("sum_price") >= lo, 1)
        .otherwise(0).alias("label"))


def _order_regression(v: Views) -> DataFrame:
    return v.order_features.select("id", *FEATURES, F.col("sum_price").alias("label"))


def _pred_score():
    return ((F.col("sum_qty") - 100.0) / 25.0
            + (F.col("n_lines").cast("double") - 4.0) * 0.25)


def _order_pred(v: Views) -> DataFrame:
    """Binary predictions of a fixed logistic formula (no model fit)."""
    p = rnd(logistic(_pred_score()))
    return (v.order_binary.select("id", "label", p.alias("probability"))
            .withColumn("prediction", F.when(F.col("probability") >= 0.5, 1).otherwise(0)))


def _order_pred_multi(v: Views) -> DataFrame:
    """Three-class predictions: softmax of logits (-z, 0.5, z)."""
    z = _pred_score()
    e0, e1, e2 = F.exp(-F.col("z")), F.exp(F.lit(0.5)), F.exp(F.col("z"))
    tot = e0 + e1 + e2
    return (v.order_multi.select("id", "label", z.alias("z"))
            .select("id", "label",
                    F.array(rnd(e0 / tot), rnd(e1 / tot), rnd(e2 / tot)).alias("probability"),
                    F.when(F.col("z") > 0.5, 2).when(F.col("z") > -0.5, 1).otherwise(0)
                    .alias("prediction")))


def _order_pred_reg(v: Views) -> DataFrame:
    pred = F.col("sum_qty") * 1900.0 + F.col("n_lines").cast("double") * 5000.0
    return v.order_regression.select("id", "label", pred.alias("prediction"))


def _vote_scores():
    # Fixed threshold rules treated as four models.
    return {
        "lines": (F.col("n_lines").cast("double") - 4.0) / 1.5,
        "price": (F.col("total_price") - 250000.0) / 125000.0,
        "qty": (F.col("sum_qty") - 96.0) / 40.0,
        "tax": (F.col("sum_tax") - 0.15) / 0.08,
    }


def _model_votes(v: Views) -> DataFrame:
    """(order, model) predictions and class-1 probabilities of the rule models."""
    structs = [F.struct(F.lit(m).alias("model"), z.alias("z")) for m, z in _vote_scores().items()]
    p = rnd(logistic(F.col("v.z")))
    return (v.order_binary.select("id", "label", F.explode(F.array(*structs)).alias("v"))
            .select("id", "label", F.col("v.model").alias("model"), p.alias("probability"))
            .withColumn("prediction", F.when(F.col("probability") >= 0.5, 1).otherwise(0)))


def _run_metrics(v: Views) -> DataFrame:
    """(run, model, metric, value): the metric bundle of each rule model."""
    from lucerna.operators.metrics import classification_metrics
    m = classification_metrics(v.model_votes, group_cols=["model"])
    return m.select(F.concat(F.col("model"), F.lit("_1")).alias("run"), "model", "metric", "value")


def _doc_quality(v: Views) -> DataFrame:
    d = v.table("documents").select("doc_id", "text", "n_chars")
    lab = v.table("labels").select("doc_id", F.col("quality").alias("label"))
    return (d.join(lab, "doc_id")
            .select(F.col("doc_id").alias("id"),
                    F.col("n_chars").cast("double").alias("n_chars"),
                    F.size(F.split(F.col("text"), " ")).cast("double").alias("n_tokens"),
                    (F.length("text") - F.length(F.regexp_replace("text", "[0-9]", "")))
                    .cast("double").alias("n_digits"),
                    "label"))


def _emb_points(v: Views) -> DataFrame:
    e = v.table("embeddings")
    return e.select(F.col("vec_id").alias("id"),
                    *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)],
                    "label")


def _part_raw(v: Views) -> DataFrame:
    """Part table with a text date, injected nulls, an empty and a constant column.

    Nulls are placed by the seeded hash H1 so SQL can place the same ones.
    """
    p = v.table("part")
    u = hash_uniform("p_partkey", 7)
    date_txt = F.date_format(F.date_add(F.to_date(F.lit("2020-01-01")),
                                        F.pmod(F.col("p_partkey"), F.lit(1000)).cast("int")),
                             "MM/dd/yyyy")
    blank = u < 0.02
    def nul(c, lo):
        return F.when(blank | (u < lo), F.lit(None)).otherwise(c)
    return p.select(
        F.col("p_partkey").alias("id"),
        F.when(blank, F.lit(None)).otherwise(F.col("p_brand")).alias("brand"),
        nul(F.col("p_size").cast("double"), 0.10).alias("size"),
        F.when(blank, F.lit(None)).otherwise(F.col("p_retailprice")).alias("price"),
        nul(date_txt, 0.05).alias("made"),
        F.lit(None).cast("double").alias("empty"),
        F.when(blank, F.lit(None)).otherwise(F.lit(1.0)).alias("const"),
        F.when(blank | (u > 0.97), F.lit(None)).otherwise(F.col("p_type")).alias("target"))


@lru_cache(maxsize=None)
def attribution_weights() -> dict:
    """Fixed weight of each (model, method, feature) used by the attribution view."""
    models = ["LR", "RF"]
    methods = ["LIME", "Shapley", "IntegratedGradients", "DiCE",
               "PermutationImportance", "RFPermutationImportance"]
    out = {}
    for mi, m in enumerate(models):
        for ki, k in enumerate(methods):
            for fi, f in enumerate(FEATURES):
                # a fixed rule: distinct, signed weights in [-1, 1]
                out[(m, k, f)] = round(((fi + 1) * (ki + 2) * (mi + 3) % 13 - 6) / 6.0, 4)
    return out


LOCAL_METHODS = ["LIME", "Shapley", "IntegratedGradients", "DiCE"]
GLOBAL_METHODS = ["PermutationImportance", "RFPermutationImportance"]


def _z_statistics(of: DataFrame) -> DataFrame:
    """One row: mean ``m_f`` and population deviation ``s_f`` of every feature."""
    return of.agg(*[F.avg(F.col(f).cast("double")).alias(f"m_{f}") for f in FEATURES],
                  *[F.stddev_pop(F.col(f).cast("double")).alias(f"s_{f}") for f in FEATURES])


def _z_score(f: str, value):
    return (value.cast("double") - F.col(f"m_{f}")) / F.when(F.col(f"s_{f}") == 0, 1.0).otherwise(F.col(f"s_{f}"))


def _attributions(v: Views) -> DataFrame:
    """Long attribution table of two models x six methods over all orders.

    Every local row of one order comes from that order's row, so z-scores,
    the probability and all (model, method, feature) attributions are built
    in-row and exploded once: no shuffle join, only the one-row statistics
    broadcast.  Global rows are one aggregate pass.
    """
    of = v.order_features
    wz = with_scalars(of, _z_statistics(of)).select(
        "id", *[_z_score(f, F.col(f)).alias(f"z_{f}") for f in FEATURES], rnd(logistic(_pred_score())).alias("probability"))
    wts = attribution_weights()
    local = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(k).alias("method"), F.lit(f).alias("feature"),
                               rnd(F.col(f"z_{f}") * F.lit(w)).alias("attribution"))
                      for (m, k, f), w in wts.items() if k in LOCAL_METHODS])
    loc = (wz.select("id", "probability", F.explode(local).alias("s"))
           .select("s.model", "s.method", F.col("id").cast("long").alias("sample_id"), "s.feature",
                   "s.attribution", "probability"))
    gkeys = [(m, k, f, w) for (m, k, f), w in wts.items() if k in GLOBAL_METHODS]
    g = wz.agg(*[F.avg(F.abs(F.col(f"z_{f}") * F.lit(w))).alias(f"g{i}") for i, (_, _, f, w) in enumerate(gkeys)])
    glob = (g.select(F.explode(F.array(*[
        F.struct(F.lit(m).alias("model"), F.lit(k).alias("method"), F.lit(f).alias("feature"),
                 rnd(F.col(f"g{i}")).alias("attribution")) for i, (m, k, f, _) in enumerate(gkeys)])).alias("s"))
        .select("s.model", "s.method", F.lit(None).cast("long").alias("sample_id"), "s.feature",
                "s.attribution", F.lit(None).cast("double").alias("probability")))
    return loc.unionByName(glob)


def _fmt2(c):
    """Text of a number rounded to 2 decimals (same text in every engine)."""
    return F.format_string("%.2f", rnd(c, 2))


def _lime_rows(v: Views) -> DataFrame:
    """LIME local rows: attributions of method LIME with the quartile range text
    of the explained value, the predicted class and its probability."""
    from lucerna.functions.ranking import exact_quantiles
    from lucerna.operators.profile import unpivot
    of = v.order_features.select("id", *FEATURES).persist()  # read by the statistics, the quartiles and the rows
    q = (exact_quantiles(unpivot(of, ["id"], FEATURES), "value", ["feature"], [0.25, 0.5, 0.75])
         .groupBy("feature").pivot("p", [0.25, 0.5, 0.75]).agg(F.first("q"))
         .toDF("feature", "q1", "q2", "q3"))
    edges = {r["feature"]: r for r in q.select("*", *[_fmt2(f"q{i}").alias(f"t{i}") for i in (1, 2, 3)]).collect()}  # one row per feature
    # an attribution meets the ranges and the predictions of its sample: copies of an id meet one another
    rows = of.groupBy("id").agg(F.collect_list(F.struct(*FEATURES)).alias("_c"))
    for part in "arp":
        rows = rows.withColumn(f"_{part}", F.explode("_c"))
    rows = with_scalars(rows, _z_statistics(of))
    rows = rows.select(F.col("id").cast("long").alias("sample_id"), *[_z_score(f, F.col(f"_a.{f}")).alias(f"z_{f}") for f in FEATURES],
                       *[F.col(f"_r.{f}").cast("double").alias(f"x_{f}") for f in FEATURES], "_p.sum_qty", "_p.n_lines")
    rows = rows.withColumn("probability", rnd(logistic(_pred_score())))

    def ranged(f: str):
        x, e = F.col(f"x_{f}"), edges[f]
        return (F.when(x <= e["q1"], f"{f} <= {e['t1']}").when(x <= e["q2"], f"{e['t1']} < {f} <= {e['t2']}")
                .when(x <= e["q3"], f"{e['t2']} < {f} <= {e['t3']}").otherwise(f"{f} > {e['t3']}"))
    made = F.array(*[F.struct(F.lit(m).alias("model"), ranged(f).alias("range"), rnd(F.col(f"z_{f}") * F.lit(w)).alias("attribution"))
                     for (m, k, f), w in attribution_weights().items() if k == "LIME" and f in edges])
    if not edges:
        made = made.cast("array<struct<model:string,range:string,attribution:double>>")
    return (rows.select("sample_id", F.when(F.col("probability") >= 0.5, 1).otherwise(0).alias("class"), "probability", F.explode(made).alias("s"))
            .select("s.model", "sample_id", "s.range", "s.attribution", "class", "probability"))


def _brand_effects(v: Views) -> DataFrame:
    """Per brand: mean retail price minus the overall mean (25 'features')."""
    p = v.table("part").select("p_brand", "p_retailprice")
    overall = p.agg(F.avg("p_retailprice").alias("_m"))
    return (p.groupBy(F.col("p_brand").alias("feature")).agg(F.avg("p_retailprice").alias("_b"))
            .transform(lambda d: with_scalars(d, overall))  # one row
            .select("feature", rnd(F.col("_b") - F.col("_m")).alias("attribution")))


def _flag_brand_effects(v: Views) -> DataFrame:
    """Per return flag (the 'sample') and brand: mean line price minus the flag's
    mean, ranked by |effect| inside the flag."""
    from pyspark.sql import Window
    li = v.table("lineitem").select("l_returnflag", "l_partkey", "l_extendedprice")
    part = v.table("part").select("p_partkey", "p_brand")
    j = li.join(part, li["l_partkey"] == part["p_partkey"])
    fb = j.groupBy(F.col("l_returnflag").alias("sample_id"), F.col("p_brand").alias("feature")).agg(
        F.avg("l_extendedprice").alias("_b"))
    fm = li.groupBy(F.col("l_returnflag").alias("sample_id")).agg(F.avg("l_extendedprice").alias("_m"))
    out = fb.join(fm, "sample_id").select("sample_id", "feature", rnd(F.col("_b") - F.col("_m")).alias("attribution"))
    w = Window.partitionBy("sample_id").orderBy(F.abs("attribution").desc(), F.col("feature"))
    return out.withColumn("rank", F.row_number().over(w).cast("long"))


def _model_quality(v: Views) -> DataFrame:
    """(model, metric): AUC of the two attribution models, taken from the rule
    models' metric bundle (LR <- 'qty', RF <- 'tax')."""
    rm = v.run_metrics.where((F.col("metric") == "Auc") & F.col("model").isin("qty", "tax"))
    return rm.select(F.when(F.col("model") == "qty", "LR").otherwise("RF").alias("model"),
                     F.col("value").alias("metric"))


def _rules_text(v: Views) -> DataFrame:
    """RIPPER-style rule text per order priority, built from that priority's
    quartiles (feature indexes refer to FEATURES): two rules per line."""
    from lucerna.functions.ranking import exact_quantiles
    from lucerna.operators.profile import unpivot
    o = v.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("source"))
    j = v.order_features.join(o, "id")
    long = unpivot(j, ["source"], ["sum_qty", "n_lines", "sum_tax"])
    q = exact_quantiles(long, "value", ["source", "feature"], [0.25, 0.5, 0.75])
    key = F.concat(F.col("feature"), F.lit("_"), (F.col("p") * 100).cast("int").cast("string"))
    w = q.withColumn("k", key).groupBy("source").pivot(
        "k", ["sum_qty_25", "sum_qty_75", "n_lines_50", "sum_tax_25"]).agg(F.first("q"))
    return w.select("source", F.concat(
        F.lit("[1="), _fmt2("sum_qty_25"), F.lit("-"), _fmt2("sum_qty_75"),
        F.lit("^0=>"), _fmt2("n_lines_50"), F.lit("] V [3=<"), _fmt2("sum_tax_25"), F.lit("]")).alias("text"))
