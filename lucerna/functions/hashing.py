"""H1: seeded, engine-independent pseudo-random numbers.

``rand()`` depends on partitioning and is not reproducible after an executor
is lost, so every random choice in the library is a pure function of
(row key, seed): md5 of ``key || '-' || seed``.  The same numbers can be
written in any SQL engine that has md5, which is what makes the seeded
operators checkable against an oracle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def _as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def seeded_hash(key, seed, *salts) -> Column:
    """md5 hex string of ``key-seed[-salt...]`` (the order key of H1)."""
    parts = [_as_col(key).cast("string"), F.lit("-"), F.lit(str(seed))]
    for s in salts:
        parts += [F.lit("-"), _as_col(s).cast("string") if not isinstance(s, (int, str)) else F.lit(str(s))]
    return F.md5(F.concat(*parts))


def hash_uniform(key, seed, *salts) -> Column:
    """Uniform number in [0, 1) from the first 32 bits of the seeded md5."""
    h = seeded_hash(key, seed, *salts)
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(TWO_32)


def hash_bucket(key, seed, n_hex: int = 4, *salts) -> Column:
    """Integer bucket from the first ``n_hex`` hex digits of the seeded md5.

    Buckets are uniform and monotone in the md5 order, so they can drive the
    distributed exact ranking of :mod:`lucerna.functions.ranking`.
    """
    h = seeded_hash(key, seed, *salts)
    return F.conv(F.substring(h, 1, n_hex), 16, 10).cast("long")
