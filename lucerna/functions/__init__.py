from lucerna.functions.exprs import dec2, logistic, rnd, safe_div
from lucerna.functions.hashing import hash_bucket, hash_uniform, seeded_hash
from lucerna.functions.ranking import (row_number_by_hash, row_number_by_value,
                                       row_number_exact, running_sums,
                                       with_hash_bucket, with_value_bucket)

__all__ = [
    "dec2", "logistic", "rnd", "safe_div",
    "hash_bucket", "hash_uniform", "seeded_hash",
    "row_number_by_hash", "row_number_by_value", "row_number_exact",
    "running_sums", "with_hash_bucket", "with_value_bucket",
]
