"""Normalisation methods, applied left to right.

SC, MM and MA are affine per column (x -> a*x + b).  A run of affine steps
is folded analytically from ONE statistics pass over the input (mean,
population std, min, max): the statistics of an affine image are affine
images of the statistics.  Non-affine steps (QT, BC, YJ, NE, BI, PF) take
their own pass over the output of the previous step.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucerna.functions.exprs import rnd
from lucerna.functions.ranking import running_sums, with_group_quantile_bucket

# Fixed method codes and the chains they stand for.
CHAINS = {"SMM": ["SC", "MM"], "SMB": ["SC", "MM", "BI"], "SMA": ["SC", "MA"]}
AFFINE = {"SC", "MM", "MA"}


def _stats(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float, float, float]]:
    row = df.agg(*[x for c in cols for x in (
        F.avg(F.col(c).cast("double")).alias(f"m_{c}"),
        F.stddev_pop(F.col(c).cast("double")).alias(f"s_{c}"),
        F.min(F.col(c).cast("double")).alias(f"lo_{c}"),
        F.max(F.col(c).cast("double")).alias(f"hi_{c}"))]).first()
    return {c: (row[f"m_{c}"], row[f"s_{c}"], row[f"lo_{c}"], row[f"hi_{c}"]) for c in cols}


def _affine_params(steps: Sequence[str], st) -> tuple[float, float]:
    """Fold affine steps over (mean, std, min, max) of a column into (a, b)."""
    mean, std, lo, hi = st
    a, b = 1.0, 0.0
    for s in steps:
        if s == "SC":                 # (x - mean) / std, std 0 -> 1
            sd = std if std else 1.0
            sa, sb = 1.0 / sd, -mean / sd
        elif s == "MM":               # (x - min) / (max - min), zero range -> scale 1
            rng = (hi - lo) if hi != lo else 1.0
            sa, sb = 1.0 / rng, -lo / rng
        elif s == "MA":               # x / max|x|, 0 -> 1
            m = max(abs(lo), abs(hi)) or 1.0
            sa, sb = 1.0 / m, 0.0
        else:
            raise ValueError(s)
        a, b = sa * a, sa * b + sb
        mean, std = sa * mean + sb, abs(sa) * std
        lo, hi = sorted((sa * lo + sb, sa * hi + sb))
    return a, b


def _apply_affine(df: DataFrame, cols: Sequence[str], steps: Sequence[str]) -> DataFrame:
    st = _stats(df, cols)
    params = {c: _affine_params(steps, st[c]) for c in cols}
    return df.select(*[(F.col(c).cast("double") * params[c][0] + params[c][1]).alias(c)
                       if c in params else F.col(c) for c in df.columns])


def scale_standard(df, cols):
    """N1 SC."""
    return _apply_affine(df, cols, ["SC"])


def scale_min_max(df, cols):
    """N2 MM."""
    return _apply_affine(df, cols, ["MM"])


def scale_max_abs(df, cols):
    """N3 MA."""
    return _apply_affine(df, cols, ["MA"])


def quantile_uniform(df: DataFrame, cols: Sequence[str], id_col: str) -> DataFrame:
    """N4 QT: value -> mean of the first and last rank of its ties, over (n - 1).

    Distinct (column, value) counts, distributed running sums in value order
    per column, then a join back on (column, value).
    """
    arr = F.array(*[F.struct(F.lit(c).alias("_c"), F.col(c).cast("double").alias("_v")) for c in cols])
    long = df.select(id_col, F.explode(arr).alias("kv")).select(id_col, "kv._c", "kv._v")
    dist = long.groupBy("_c", "_v").agg(F.count(F.lit(1)).alias("_cnt"))
    keyed = with_group_quantile_bucket(dist, "_v", ["_c"])
    run = running_sums(keyed, ["_v"], {"_cum": F.col("_cnt")}, ["_c"])
    tot = dist.groupBy("_c").agg(F.sum("_cnt").alias("_n"))
    qt = (run.join(tot, "_c")
          .select("_c", "_v", F.when(F.col("_n") <= 1, 0.0).otherwise(
              (2.0 * F.col("_cum") - F.col("_cnt") - 1.0) / (2.0 * (F.col("_n") - 1.0))).alias("_q")))
    mapped = long.join(qt, ["_c", "_v"], "left")
    wide = mapped.groupBy(id_col).pivot("_c", list(cols)).agg(F.first("_q"))
    other = [c for c in df.columns if c not in cols]
    if other == [id_col]:
        return wide.select(id_col, *cols)
    return df.select(*other).join(wide, id_col).select(*df.columns)


def _boxcox_t(x, lam: float):
    return F.log(x) if lam == 0 else (F.pow(x, F.lit(lam)) - 1.0) / lam


def _yj_t(x, lam: float):
    pos = F.log1p(x) if lam == 0 else (F.pow(x + 1.0, F.lit(lam)) - 1.0) / lam
    neg = -F.log1p(-x) if lam == 2 else -(F.pow(1.0 - x, F.lit(2.0 - lam)) - 1.0) / (2.0 - lam)
    return F.when(x >= 0, pos).otherwise(neg)


def _lambda_search(df: DataFrame, cols: Sequence[str], kind: str,
                   lo: float = -2.0, hi: float = 2.0, steps: int = 17, rounds: int = 4) -> dict[str, float]:
    """H4: profile log-likelihood maximised over a lambda grid, narrowed each round.

    Each round is ONE aggregate pass evaluating every (column, lambda).
    """
    t = _boxcox_t if kind == "BC" else _yj_t
    bounds = {c: (lo, hi) for c in cols}
    best = {c: 0.0 for c in cols}
    for _ in range(rounds):
        grids = {c: [bounds[c][0] + i * (bounds[c][1] - bounds[c][0]) / (steps - 1) for i in range(steps)]
                 for c in cols}
        aggs = [F.count(F.lit(1)).alias("n")]
        for c in cols:
            x = F.col(c).cast("double")
            j = F.log(x) if kind == "BC" else F.signum(x) * F.log1p(F.abs(x))
            aggs.append(F.sum(j).alias(f"j_{c}"))
            for i, lam in enumerate(grids[c]):
                aggs.append(F.var_pop(t(x, lam)).alias(f"v_{c}_{i}"))
        row = df.agg(*aggs).first()
        n = row["n"]
        for c in cols:
            scores = []
            for i, lam in enumerate(grids[c]):
                v = row[f"v_{c}_{i}"]
                ll = -math.inf if not v or v <= 0 else -n / 2.0 * math.log(v) + (lam - 1.0) * row[f"j_{c}"]
                scores.append((ll, -abs(lam), lam))
            k = max(range(steps), key=lambda i: scores[i])
            lam = grids[c][k]
            best[c] = lam
            step = (bounds[c][1] - bounds[c][0]) / (steps - 1)
            if k in (0, steps - 1):   # best at the edge: widen towards it
                bounds[c] = (lam - (steps - 1) * step / 2, lam + (steps - 1) * step / 2)
            else:
                bounds[c] = (lam - step, lam + step)
    return best


def power_transform(df: DataFrame, cols: Sequence[str], kind: str = "YJ") -> tuple[DataFrame, dict]:
    """N5 BC (strictly positive data only) / N6 YJ with maximum-likelihood lambda."""
    if kind == "BC":
        bad = df.agg(*[F.sum(F.when(F.col(c) <= 0, 1).otherwise(0)).alias(c) for c in cols]).first()
        if any(bad[c] for c in cols):
            raise ValueError("Box-Cox needs strictly positive data")
    # several aggregate passes over the same input: keep it materialised
    base = df.select(*cols).persist()
    try:
        lams = _lambda_search(base, cols, kind)
    finally:
        base.unpersist()
    t = _boxcox_t if kind == "BC" else _yj_t
    out = df.select(*[t(F.col(c).cast("double"), lams[c]).alias(c) if c in cols else F.col(c)
                      for c in df.columns])
    return out, lams


def normalize_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """N7 NE: each row divided by its L2 norm; zero rows unchanged."""
    norm = F.sqrt(sum((F.col(c).cast("double") * F.col(c).cast("double") for c in cols), F.lit(0.0)))
    d = F.when(norm == 0, 1.0).otherwise(norm)
    return df.select(*[(F.col(c).cast("double") / d).alias(c) if c in cols else F.col(c)
                       for c in df.columns])


def binarize(df: DataFrame, cols: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """N8 BI: 1.0 if x > threshold else 0.0.

    x is compared at 1e-12 resolution, so a value that equals the threshold in
    exact arithmetic (e.g. the midpoint after MM) is not flipped by last-bit
    noise of the preceding scaling steps.
    """
    return df.select(*[F.when(rnd(c, 12) > threshold, 1.0).otherwise(0.0).alias(c) if c in cols
                       else F.col(c) for c in df.columns])


def feature_names_after(cols: Sequence[str], methods: Sequence[str] | str) -> list[str]:
    """The feature columns that :func:`normalise` leaves (PF adds a bias, squares and products)."""
    names = list(cols)
    for m in [methods] if isinstance(methods, str) else methods:
        for step in CHAINS.get(m, [m]):
            if step == "PF":
                names = ["1", *names, *[f"{a}^2" if a == b else f"{a} {b}"
                                        for i, a in enumerate(names) for b in names[i:]]]
    return names


def polynomial_features(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """N9 PF: degree 2 with bias, in the order 1, x_i, x_i*x_j (i <= j)."""
    cols = list(cols)
    other = [c for c in df.columns if c not in cols]
    new = [F.lit(1.0).alias("1")] + [F.col(c).cast("double").alias(c) for c in cols]
    for i, a in enumerate(cols):
        for b in cols[i:]:
            name = f"{a}^2" if a == b else f"{a} {b}"
            new.append((F.col(a).cast("double") * F.col(b).cast("double")).alias(name))
    return df.select(*other, *new)


def normalise(df: DataFrame, cols: Sequence[str], methods: Sequence[str] | str,
              id_col: str | None = None) -> DataFrame:
    """Apply method codes left to right (SC MM MA QT BC YJ NE BI PF SMM SMB SMA)."""
    if isinstance(methods, str):
        methods = [methods]
    steps: list[str] = []
    for m in methods:
        steps += CHAINS.get(m, [m])
    cols = list(cols)
    i = 0
    while i < len(steps):
        if steps[i] in AFFINE:
            j = i
            while j < len(steps) and steps[j] in AFFINE:
                j += 1
            df = _apply_affine(df, cols, steps[i:j])
            i = j
            continue
        s = steps[i]
        if s == "QT":
            df = quantile_uniform(df, cols, id_col or df.columns[0])
        elif s in ("BC", "YJ"):
            df, _ = power_transform(df, cols, s)
        elif s == "NE":
            df = normalize_rows(df, cols)
        elif s == "BI":
            df = binarize(df, cols)
        elif s == "PF":
            df = polynomial_features(df, cols)
            cols = feature_names_after(cols, "PF")
        else:
            raise ValueError(f"unknown normalisation {s}")
        i += 1
    return df
