"""ML8 RIPPERk rule learning (Cohen 1995) and ML19 rule text.

Rules for the positive (by default the minority) class over quantile-binned
features.  Rows collapse first to counts of distinct bin vectors (per twelfth of the
rows, by H1, for the splits), kept as blocks of bytes; every step below is one pass
over them, and only features x bins sums of a task reach the driver.

* grow: starting from an empty rule, add the condition with the best FOIL gain
  p1 (log2 p1/(p1+n1) - log2 p0/(p0+n0)) until no negative is covered or none gains;
* prune: on the held-out third, keep the condition prefix with the best
  (p - n) / (p + n); all prefixes are scored in one aggregate;
* cover: rules are added until no positive is left, a rule is wrong on most of the
  held-out rows it covers, or the description length exceeds the least one so far
  by ``dl_allowance`` bits;
* optimise, ``k`` rounds: every rule competes with a replacement (grown anew) and a
  revision (grown on from it), both pruned for the error of the whole rule set; the
  one with the least description length stays.  Positives left over are covered
  again and rules that cost more bits than they save are dropped.  A round that
  does not shorten the description is taken back, so its length never rises.

The description length is that of the rules (conditions chosen among all, half
weight for their redundancy) plus that of the exceptions (which covered rows are
negative, which others are positive).  Thresholds are bin edges (exact quantiles),
so a condition on the bin index is a condition on the value.  A null value meets no
condition.  There is no limit on rules or conditions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lucerna.functions.hashing import hash_uniform
from lucerna.functions.ranking import exact_quantiles
from lucerna.session import checkpoint_dir

Rule = list[tuple[str, str, int]]
CELLS_A_TASK = 150_000
CELLS_A_BLOCK = 50_000
MISSING = 65_535  # bin of a null value
NO_PART = 255  # part of a row without an id: neither grown on nor held out
PARTS = 12  # parts of the rows by hash; a third of them is held out, another third for every rule


def _bin_index(c: str, edges: list[float]) -> Column:
    """Number of edges strictly below the value (x <= edge_k  <=>  bin <= k); null for a null value."""
    x = F.col(c).cast("double")
    return F.when(x.isNotNull(), F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e < x)))


def _covered(bins: np.ndarray, conds: Rule, cols: list[str]) -> np.ndarray:
    """Which rows a rule covers; ``bins`` holds one line per feature."""
    out = np.ones(bins.shape[1], bool)
    for f, op, k in conds:
        b = bins[cols.index(f)]
        out &= (b <= k) if op == "<=" else (b > k) & (b != MISSING)
    return out


def _any(bins: np.ndarray, rules: Sequence[Rule], cols: list[str]) -> np.ndarray:
    out = np.zeros(bins.shape[1], bool)
    for r in rules:
        out |= _covered(bins, r, cols)
    return out


def _only(bins: np.ndarray, rules: Sequence[Rule], cols: list[str]) -> list[np.ndarray]:
    """Per rule, the rows that it alone covers."""
    each = [_covered(bins, r, cols) for r in rules]
    hits = np.sum(each, axis=0)
    return [e & (hits == 1) for e in each]


@dataclass(frozen=True)
class _Rows:
    """The rows a step looks at: those that no rule of ``without`` covers, grown on or held out in ``turn`` (None: both)."""

    without: tuple = ()
    turn: int | None = None
    held_out: bool = False

    def of(self, part: np.ndarray, bins: np.ndarray, held: int, cols: list[str]) -> np.ndarray:
        out = ~_any(bins, self.without, cols)
        if self.turn is not None:
            out &= (part != NO_PART) & (((part.astype(np.int64) + 5 * self.turn) % PARTS < held) == self.held_out)
        return out


ALL = _Rows()


def _pack(d: int):
    """mapInArrow body: the cells of a task as blocks of bytes (part, bins by feature, positives, negatives)."""
    def block(parts: list[np.ndarray]) -> pa.RecordBatch:
        m = np.concatenate(parts, axis=1)
        kinds = [(m[0], np.uint8), (m[1:d + 1], np.uint16), (m[d + 1], np.int64), (m[d + 2], np.int64)]
        return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(x, t).tobytes()], pa.binary()) for x, t in kinds], ["h", "b", "p", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            if batch.num_rows:
                parts.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]))
                size += batch.num_rows
            if size >= CELLS_A_BLOCK:
                yield block(parts)
                parts, size = [], 0
        if parts:
            yield block(parts)
    return run


def _sums(answer, d: int):
    """mapInArrow body: the sum over a task's blocks of ``answer(part, bins, positives, negatives)``, whole numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for h, b, p, n in zip(*batch.columns, strict=True):
                part = np.frombuffer(h.as_buffer(), np.uint8)
                one = answer(part, np.frombuffer(b.as_buffer(), np.uint16).reshape(d, -1), *(np.frombuffer(x.as_buffer(), np.int64) for x in (p, n)))
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.int64).tobytes()], pa.binary())], ["sums"])
    return run


def _value_cover(conds: Rule, edges) -> Column:
    c = F.lit(True)
    for f, op, k in conds:
        x = F.col(f"`{f}`").cast("double")
        c = c & ((x <= edges[f][k]) if op == "<=" else (x > edges[f][k]))
    return F.coalesce(c, F.lit(False))


def _log2_choose(n: float, k: float) -> float:
    return (math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)) / math.log(2)


def rules_bits(rules: Sequence[Rule], conditions: int) -> float:
    """Bits that say which of all ``conditions`` each rule holds; half of them, as conditions overlap."""
    return sum(0.5 * (math.log2(conditions + 1) + _log2_choose(max(conditions, len(r)), len(r))) for r in rules)


def exception_bits(covered: tuple[int, int], total: tuple[int, int]) -> float:
    """Bits that say which covered rows are negative and which of the others are positive; (positive, negative) counts."""
    (p, n), (tp, tn) = covered, total
    return math.log2(p + n + 1) + _log2_choose(p + n, n) + math.log2(tp + tn - p - n + 1) + _log2_choose(tp + tn - p - n, tp - p)


class _Learner:
    """One positive class over the collapsed table: counts, growing, pruning and description lengths."""

    def __init__(self, blocks: DataFrame, cols: list[str], edges: dict[str, list[float]], prune_size: float):
        self.blocks, self.cols, self.edges = blocks, cols, edges
        self.held = max(1, min(PARTS - 1, round(prune_size * PARTS)))
        self.conditions = 2 * sum(len(e) for e in edges.values())
        self.turn = 0
        self.total = self.counts(ALL, [[()]])[0]

    def ask(self, answer, size: int) -> np.ndarray:
        """One pass over the blocks; a task sends one array of ``size`` sums."""
        found = self.blocks.mapInArrow(_sums(answer, len(self.cols)), "sums binary").collect()
        return sum((np.frombuffer(r[0], np.int64) for r in found), np.zeros(size, np.int64))

    def counts(self, rows: _Rows, covers: Sequence[Sequence[Rule]], alone: Sequence[Rule] = ()) -> list[tuple[int, int]]:
        """(positives, negatives) under each rule set, then those of each rule of ``alone`` that no other of them covers, in one pass."""
        held, cols = self.held, self.cols

        def answer(part, bins, p, n):
            use = rows.of(part, bins, held, cols)
            marks = [_any(bins, c, cols) for c in covers] + (_only(bins, alone, cols) if alone else [])
            return np.array([x[use & m].sum() for m in marks for x in (p, n)], np.int64)
        found = self.ask(answer, 2 * (len(covers) + len(alone))).tolist()
        return list(zip(found[::2], found[1::2], strict=True))

    def split(self, without: Sequence[Rule] = ()) -> tuple[_Rows, _Rows]:
        """Rows to grow on and rows held out, another third every time."""
        self.turn += 1
        return _Rows(tuple(without), self.turn - 1, False), _Rows(tuple(without), self.turn - 1, True)

    def histogram(self, rows: _Rows, conds: Rule) -> tuple[tuple[int, int], np.ndarray]:
        """(positives, negatives) that a rule covers, and the same by feature and bin."""
        held, cols, width = self.held, self.cols, max((len(e) for e in self.edges.values()), default=0) + 1

        def answer(part, bins, p, n):
            use = np.flatnonzero(rows.of(part, bins, held, cols) & _covered(bins, conds, cols))
            p, n = p[use], n[use]
            out = [np.array([p.sum(), n.sum()])]
            for line in bins:
                b = np.minimum(line[use], width)  # the last place takes the missing values
                out += [np.bincount(b, x, width + 1)[:width] for x in (p, n)]
            return np.rint(np.concatenate(out)).astype(np.int64)
        found = self.ask(answer, 2 + 2 * width * len(cols))
        return tuple(found[:2].tolist()), found[2:].reshape(len(cols), 2, width)

    def grow(self, rows: _Rows, start: Rule = ()) -> Rule:
        conds = list(start)
        while True:
            (p0, n0), table = self.histogram(rows, conds)
            if not (p0 and n0):
                break
            best, base = None, math.log2(p0 / (p0 + n0))
            for c, (ps, ns) in zip(self.cols, table, strict=True):
                upto, whole = (np.cumsum(ps).tolist(), np.cumsum(ns).tolist()), (int(ps.sum()), int(ns.sum()))
                for k in range(len(self.edges[c])):
                    for op in ("<=", ">"):
                        p1, n1 = upto[0][k], upto[1][k]
                        if op == ">":
                            p1, n1 = whole[0] - p1, whole[1] - n1
                        if p1 and (p1, n1) != (p0, n0):
                            gain = p1 * (math.log2(p1 / (p1 + n1)) - base)
                            if gain > 1e-12 and (best is None or (gain, -n1) > best[:2]):
                                best = (gain, -n1, c, op, k)
            if best is None:
                break
            _, fewer, c, op, k = best
            conds = [x for x in conds if x[:2] != (c, op)] + [(c, op, k)]  # a tighter bound replaces the one before
            if not fewer:
                break
        return conds

    def prune(self, conds: Rule, held: _Rows) -> tuple[Rule, tuple[int, int]]:
        """The prefix with the best (p - n) / (p + n) on held-out rows, the shortest of equals, and its counts."""
        found = self.counts(held, [[conds[:i]] for i in range(1, len(conds) + 1)])
        worth = [((p - n) / (p + n) if p + n else -1.0, -i) for i, (p, n) in enumerate(found)]
        at = max(range(len(found)), key=lambda i: worth[i])
        return conds[:at + 1], found[at]

    def prune_for_set(self, conds: Rule, others: Sequence[Rule], held: _Rows) -> Rule:
        """The prefix with which the whole rule set has the fewest errors on held-out rows, the shortest of equals."""
        found = self.counts(held, [[*others, conds[:i]] for i in range(1, len(conds) + 1)])
        at = min(range(len(found)), key=lambda i: (found[i][1] - found[i][0], i))
        return conds[:at + 1]

    def bits(self, rules: Sequence[Rule], covered: tuple[int, int]) -> float:
        return rules_bits(rules, self.conditions) + exception_bits(covered, self.total)

    def length(self, rules: Sequence[Rule]) -> float:
        """Description length of a rule set."""
        return self.bits(rules, self.counts(ALL, [rules])[0])

    def cover(self, rules: list[Rule], allowance: float) -> list[Rule]:
        """Adds rules for the positives that ``rules`` leave over."""
        rules = list(rules)
        least = self.length(rules)
        while True:
            grow, held = self.split(rules)
            conds = self.grow(grow)
            if not conds:
                return rules
            rule, (p, n) = self.prune(conds, held)
            if p <= n:  # wrong on half of the held-out rows, or none is covered
                return rules
            length = self.length([*rules, rule])
            if length > least + allowance:
                return rules
            rules.append(rule)
            least = min(least, length)

    def optimise(self, rules: list[Rule]) -> list[Rule]:
        """Every rule against its replacement and its revision."""
        rules = list(rules)
        for i, rule in enumerate(rules):
            others = rules[:i] + rules[i + 1:]
            grow, held = self.split(others)
            _, whole = self.split()
            tried = [rule]
            for start in ((), rule):
                conds = self.grow(grow, start)
                if conds:
                    pruned = self.prune_for_set(conds, others, held if not others else whole)
                    if pruned not in tried:
                        tried.append(pruned)
            if len(tried) > 1:
                found = self.counts(ALL, [[*others, t] for t in tried])
                lengths = [self.bits([*others, t], c) for t, c in zip(tried, found, strict=True)]
                rules[i] = tried[min(range(len(tried)), key=lambda j: (lengths[j], j))]
        return rules

    def drop(self, rules: list[Rule]) -> tuple[list[Rule], float]:
        """Without the rules that lengthen the description, the worst first; and its length."""
        rules = list(rules)
        while True:
            # without a rule, the rows go that no other rule covers
            whole, *alone = self.counts(ALL, [rules], rules)
            lengths = [self.bits(rules, whole), *[self.bits(rules[:i] + rules[i + 1:], (whole[0] - p, whole[1] - n))
                                                  for i, (p, n) in enumerate(alone)]]
            best = min(range(len(lengths)), key=lambda i: (lengths[i], i))
            if best == 0:
                return rules, lengths[0]
            rules.pop(best - 1)


def fit_ripper(df: DataFrame, feature_cols: Sequence[str], label: str = "label", id_col: str = "id",
               positive=None, n_bins: int = 10, k: int = 2, prune_size: float = 1.0 / 3.0,
               dl_allowance: float = 64.0, seed=2020) -> dict:
    """Learn a rule list for the positive class with ``k`` optimisation rounds.

    Returns a small model dict: positive and negative class, feature edges,
    rules as (feature, op, edge index) and ``history``, the number of rules
    and the description length (bits) after covering and after every round.
    """
    checkpoint_dir(df.sparkSession)
    cols = list(feature_cols)
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    if positive is None:
        positive = min(counts, key=lambda c: (counts[c], c))
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v"))
                                         for c in cols])).alias("s")).select("s.*")
    qrows = exact_quantiles(long, "v", ["feature"], [i / n_bins for i in range(1, n_bins)]).collect()
    edges = {c: sorted({r["q"] for r in qrows if r["feature"] == c}) for c in cols}
    y = (F.col(label) == F.lit(positive)).cast("long")
    bins = [_bin_index(c, edges[c]).alias(f"_b_{c}") for c in cols]
    cells = (df.select(y.alias("_y"), F.floor(hash_uniform(id_col, seed, "prune") * PARTS).cast("int").alias("_h"), *bins)
             .groupBy("_h", *[f"_b_{c}" for c in cols]).agg(F.sum("_y").alias("p"), F.sum(1 - F.col("_y")).alias("n")).checkpoint())
    # they are read some hundred times: packed once, and no more tasks than their size asks for
    whole = cells.select(F.coalesce("_h", F.lit(NO_PART)), *[F.coalesce(f"_b_{c}", F.lit(MISSING)) for c in cols],
                         F.coalesce("p", F.lit(0)), F.coalesce("n", F.lit(0)))
    blocks = whole.coalesce(-(-max(1, cells.count()) // CELLS_A_TASK)).mapInArrow(_pack(len(cols)), "h binary, b binary, p binary, n binary").persist()
    learner = _Learner(blocks, cols, edges, prune_size)
    rules, length = learner.drop(learner.cover([], dl_allowance))
    history = [(len(rules), length)]
    for _ in range(k):
        again, shorter = learner.drop(learner.cover(learner.optimise(rules), dl_allowance))
        if shorter < length:
            rules, length = again, shorter
        history.append((len(rules), length))
    blocks.unpersist()
    return {"positive": positive, "edges": edges, "rules": rules, "history": history,
            "negative": next((c for c in sorted(counts) if c != positive), None)}


def predict_ripper(model: dict, df: DataFrame, id_col: str = "id") -> DataFrame:
    """Positive class when any rule covers the row (first covering rule reported)."""
    hit = F.lit(None).cast("int")
    for i in reversed(range(len(model["rules"]))):
        hit = F.when(_value_cover(model["rules"][i], model["edges"]), F.lit(i)).otherwise(hit)
    pos, neg = model["positive"], model["negative"]
    return df.select(id_col, *([c for c in ("label",) if c in df.columns]), hit.alias("rule_no"),
                     F.when(hit.isNotNull(), F.lit(pos)).otherwise(F.lit(neg)).alias("prediction"))


def ripper_text(model: dict) -> str:
    """Rule text in RIPPER layout: rules joined by ' V ', conditions by '^'."""
    parts = []
    for rule in model["rules"]:
        parts.append("[" + "^".join(f"{f}{op}{model['edges'][f][k]!r}" for f, op, k in rule) + "]")
    return " V ".join(parts)


def ripper_rules_table(spark, model: dict) -> DataFrame:
    """ML19: one row per rule, ``feature op value and ...``."""
    rows = [(i, " and ".join(f"{f} {op} {model['edges'][f][k]:.2f}" for f, op, k in rule))
            for i, rule in enumerate(model["rules"])]
    return spark.createDataFrame(rows or [(-1, "")], "rule_no int, rule string")


def ripper_history(spark, model: dict) -> DataFrame:
    """``round, n_rules, bits``: the description length after covering (round 0) and after each round."""
    return spark.createDataFrame([(i, n, float(b)) for i, (n, b) in enumerate(model["history"])], "round int, n_rules int, bits double")
