"""Vector code compression and whitening against numpy over the whole table."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lucerna.llm import partcodes, whitening
from lucerna.llm.common import table

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<double>, label int, n long, x array<int>, codes string, whitened double, deviation string"


@pytest.fixture(scope="module")
def odd(spark):
    """Unusable vectors, repeats, null ids and labels, another length, huge values, clashing column names."""
    rng = np.random.default_rng(4)
    good = [(i, rng.normal(size=16).tolist(), i % 3 or None) for i in range(40)]
    rows = [*good, good[7], good[7], (None, good[3][1], 1), (7, good[5][1], 2), (90, None, 1), (91, [], 1), (92, [1.0] * 15 + [None], 1),
            (93, [NAN] * 16, 1), (94, [INF] + [0.0] * 15, None), (95, [1.0] * 8, 1), (96, [1e300] + [0.0] * 15, 0)]
    return spark.createDataFrame([(*r, 1, [1], "c", 0.5, "d") for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_codes(ids, vectors, labels, limit, parts=8, entries=16, rounds=6):
    """Plain Lloyd rounds over Python's whole numbers, all entries compared."""
    x = np.array([[max(-limit, min(limit, math.floor(4096 * c))) if abs(c) < 1e290 else int(math.copysign(limit, c)) for c in v]
                  for v in vectors], object)
    first = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, x[i].tolist()))[:entries]
    cut = [(p * x.shape[1] // parts, (p + 1) * x.shape[1] // parts) for p in range(parts)]
    books = [[x[i, lo:hi].tolist() for i in first] for lo, hi in cut]

    def assign():
        found = []
        for (lo, hi), book in zip(cut, books, strict=True):
            d = [[sum((a - b) ** 2 for a, b in zip(row, e, strict=True)) for e in book] for row in x[:, lo:hi].tolist()]
            found.append([(row.index(min(row)), min(row)) for row in d])
        return found
    for _ in range(rounds):
        for p, of in enumerate(assign()):
            lo, hi = cut[p]
            for k in range(len(books[p])):
                own = [x[i, lo:hi] for i, (e, _) in enumerate(of) if e == k]
                if own:
                    books[p][k] = [int(s) // len(own) for s in sum(own)]
    found = assign()
    code = ["".join(f"{of[i][0]:02x}" for of in found) for i in range(len(ids))]
    error = [sum(of[i][1] for of in found) for i in range(len(ids))]
    total = {y: sum(e for e, z in zip(error, labels, strict=True) if z == y) for y in set(labels)}
    sha = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return sorted(zip(map(str, ids), code, error, [total[y] for y in labels], [sha] * len(ids), strict=True))


def rows_of(df, *columns):
    return sorted(tuple([str(r[0]), *r[1:]]) for r in df.select(*columns).collect())


CODE_COLUMNS = ("vec_id", "code", "error", "label_error", "codebooks_sha256")


def test_codes_equal_brute_force(spark, sf_small):
    e = table(spark, sf_small, "embeddings")
    rows = e.collect()
    want = brute_codes([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], partcodes.component_limit(64, 8))
    assert rows_of(partcodes.report(e), *CODE_COLUMNS) == want


def test_codes_of_odd_rows(spark, odd, nothing, monkeypatch):
    usable = [r for r in odd.collect() if r[1] and len(r[1]) == 16 and all(c is not None and math.isfinite(c) for c in r[1])]
    want = brute_codes([r[0] for r in usable], [r[1] for r in usable], [r[2] for r in usable], partcodes.component_limit(16, 8))
    assert rows_of(partcodes.report(odd), *CODE_COLUMNS) == want and len(want) == 45
    monkeypatch.setattr(partcodes, "FEW_LABELS", 0)  # the shuffled join of the label sums
    assert rows_of(partcodes.report(odd), *CODE_COLUMNS) == want
    assert partcodes.report(nothing).count() == 0
    few = odd.where("vec_id in (1, 2, 3)")
    assert {r["error"] for r in partcodes.report(few).collect()} == {0}


def test_equal_average_search_keeps_ties_and_decodes():
    rng = np.random.default_rng(1)
    for spread, d in ((2, 3), (50, 8), (1000, 1)):
        book, rows = rng.integers(-spread, spread, (16, d)), rng.integers(-spread, spread, (500, d))
        distance = ((rows[:, None] - book[None]) ** 2).sum(2)
        index, best = partcodes.nearest(rows, book)
        assert (index == distance.argmin(1)).all() and (best == distance.min(1)).all()
    books = partcodes.Codebooks(4, (np.array([[0, 1], [5, 5]]), np.array([[7, 7], [1, 2]])))
    codes, error = books.assign(np.array([[5, 6, 1, 2]]))
    assert codes.tolist() == [[1, 1]] and error.tolist() == [[1, 0]] and books.decode(codes).tolist() == [[5, 5, 1, 2]]


def test_first_codebook_holds_the_smallest_ids(spark, odd):
    vectors = spark.createDataFrame([(i, [i, 2 * i]) for i in range(30, 0, -1)] + [(None, [0, 0])], "vec_id long, x array<long>")
    books = partcodes.fit_codebooks(vectors, 2, 2, 4, rounds=0)
    assert [b.ravel().tolist() for b in books.books] == [[1, 2, 3, 4], [2, 4, 6, 8]]


# ---- whitening

def check_whitening(df, x, tolerance=1e-9):
    """Rows of ``report`` against the eigenvectors of the covariance of ``x`` (long rows by vec_id)."""
    n, d = x.shape
    rows = df.orderBy("vec_id", "component").collect()
    k = min(8, d)
    assert len(rows) == n * k
    white = np.array([r["whitened"] for r in rows]).reshape(n, k)
    c = x - x.mean(0)
    values = np.linalg.svd(c)[1][:k] ** 2 / n
    s = x.astype(object).sum(0)
    exact = ((x.astype(object) * n - s) ** 2).sum(1)
    assert [r["deviation"] for r in rows[::k]] == [int(v) if v < 2 ** 63 else None for v in exact]
    assert {r["n"] for r in rows} == {n}
    explained = np.array([r["explained"] for r in rows[:k]])
    assert np.allclose(explained, values / (c ** 2).sum() * n, rtol=1e-4)
    assert np.abs(white.T @ white / n - np.eye(k)).max() <= max(rows[0]["identity_error"], 1e-6) <= 1e-4
    # each component is an eigenvector: projecting the covariance back gives its eigenvalue
    vectors = np.linalg.lstsq(c, white * np.sqrt(values), rcond=None)[0]
    assert np.abs(c.T @ (c @ vectors) / n - vectors * values).max() <= tolerance * values[0]
    return white, values


def test_whitening_equals_the_eigenvectors(spark, sf_small):
    e = table(spark, sf_small, "embeddings").orderBy("vec_id")
    x = np.floor(1024 * np.array([r["embedding"] for r in e.collect()], float)).astype(np.int64) + 100_000
    check_whitening(whitening.report(e), x)


def test_whitening_of_ill_conditioned_rows(spark):
    """Components whose variances differ by 10^13, the smallest of them among the first eight."""
    rng = np.random.default_rng(3)
    basis = np.linalg.qr(rng.normal(size=(8, 8)))[0]
    x = np.floor(rng.normal(size=(4000, 8)) * 10.0 ** np.linspace(0.5, 7, 8) @ basis.T * 1024) / 1024
    df = spark.createDataFrame([(i, r) for i, r in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(5)
    long = np.floor(1024 * x).astype(np.int64) + 100_000
    n = len(long)
    got = whitening.report(df).orderBy("vec_id", "component").collect()
    c = long - long.mean(0)
    values = np.linalg.svd(c, compute_uv=False) ** 2 / n
    assert values[0] / values[-1] > 1e12
    share = np.array([r["explained"] for r in got[:8]])
    assert np.allclose(share, values / values.sum(), rtol=1e-4) and got[0]["identity_error"] <= 1e-4


def test_triangular_factor_is_that_of_the_rows(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(-1000, 1000, (300, 5))
    df = spark.createDataFrame([(r,) for r in x.tolist()], "x array<long>").repartition(4)
    n, sums = whitening.column_sums(df, 5)
    r, total = whitening.triangular_factor(df, 5, n, sums)
    c = x - x.mean(0)
    q = whitening.solve_right(c, r)
    assert np.allclose(np.tril(r, -1), 0) and np.allclose(q.T @ q, np.eye(5)) and total == pytest.approx((c ** 2).sum())


def test_whitening_of_odd_rows(spark, odd, nothing):
    usable = [r for r in odd.where("vec_id <> 96 or vec_id is null").collect()
              if r[1] and len(r[1]) == 16 and all(c is not None and math.isfinite(c) for c in r[1])]
    out = whitening.report(odd.where("vec_id <> 96 or vec_id is null"))
    assert out.count() == 8 * len(usable) == 8 * 44
    assert out.where("vec_id is null").count() == 8 and out.where("vec_id = 7").count() == 8 * 4
    assert out.agg(F.max("identity_error")).first()[0] <= 1e-4
    assert whitening.report(odd).count() == 8 * 45  # a component beyond the limit
    assert whitening.report(nothing).count() == 0
    one = whitening.report(odd.where("vec_id = 1")).collect()
    assert len(one) == 8 and {(r["whitened"], r["explained"], r["deviation"], r["identity_error"]) for r in one} == {(0.0, 0.0, 0, 0.0)}


def test_dimensions_that_depend_on_each_other(spark):
    """A constant and a repeated dimension: three components with variance, the others 0."""
    rng = np.random.default_rng(6)
    a = rng.normal(size=(200, 3))
    x = np.concatenate([a, a[:, :1], np.ones((200, 1))], 1)
    df = spark.createDataFrame([(i, r) for i, r in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    out = whitening.report(df)
    assert out.where("component > 3 and (abs(whitened) > 0 or explained > 0)").count() == 0
    assert out.where("component <= 3").agg(F.max("identity_error")).first()[0] <= 1e-4
