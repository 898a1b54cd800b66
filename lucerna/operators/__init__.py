"""DataFrame operators of the library (prep, scale, sample, folds, models, metrics, explain, consensus, results, rules, generate)."""
