"""ML8: planted rules are found again, the description never grows, nothing is capped."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lucerna.operators import ripper as RP


def _rows(spark, truth, n=3000, noise=0.0, seed=1, features="abcd"):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x = {c: rng.random() for c in features}
        y = int(truth(x))
        rows.append((i, *x.values(), 1 - y if rng.random() < noise else y))
    schema = "id long, " + ", ".join(f"{c} double" for c in features) + ", label int"
    return spark.createDataFrame(rows, schema).repartition(4)


def _accuracy(model, df):
    return RP.predict_ripper(model, df).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]


@pytest.mark.parametrize("noise", [0.0, 0.05])
def test_planted_rules_are_recovered(spark, noise):
    truth = lambda x: (x["a"] <= 0.3 and x["b"] > 0.6) or (x["c"] > 0.8 and x["a"] > 0.5)
    model = RP.fit_ripper(_rows(spark, truth, noise=noise), list("abcd"))
    assert model["positive"] == 1
    clean = _rows(spark, truth, seed=2)
    assert _accuracy(model, clean) > 0.97
    got = [{(f, op): model["edges"][f][k] for f, op, k in rule} for rule in model["rules"]]
    for want in ({("a", "<="): 0.3, ("b", ">"): 0.6}, {("c", ">"): 0.8, ("a", ">"): 0.5}):
        assert any(set(want) <= set(r) and all(abs(r[c] - v) < 0.05 for c, v in want.items()) for r in got)
    bits = [b for _, b in model["history"]]
    assert len(bits) == 3 and all(y <= x + 1e-9 for x, y in zip(bits, bits[1:]))


def test_a_rule_of_six_conditions_and_a_dozen_rules(spark):
    """Longer than the four conditions and ten rules that used to be the limits."""
    six = lambda x: all(x[c] > 0.2 for c in "abcdef")
    model = RP.fit_ripper(_rows(spark, six, 4000, features="abcdef"), list("abcdef"), positive=1, k=0)
    assert max(len(r) for r in model["rules"]) >= 6
    stripes = lambda x: int(x["a"] * 10) % 2 == 0 and int(x["b"] * 10) % 3 == 0
    df = _rows(spark, stripes, 6000, features="ab")
    model = RP.fit_ripper(df, ["a", "b"], k=0)
    assert len(model["rules"]) >= 12 and _accuracy(model, df) > 0.93


def test_description_length_of_hand_made_sets():
    total = (10, 90)
    perfect = RP.exception_bits((10, 0), total)
    assert perfect == pytest.approx(math.log2(11) + math.log2(91))
    assert RP.exception_bits((5, 0), total) > perfect and RP.exception_bits((10, 10), total) > perfect
    assert RP.rules_bits([[("a", "<=", 1)]], 16) == pytest.approx(0.5 * (math.log2(17) + 4))


def test_noise_gives_no_rules_and_nulls_meet_no_condition(spark):
    df = _rows(spark, lambda x: random.Random(x["a"]).random() < 0.3, 1500)
    model = RP.fit_ripper(df, list("abcd"))
    assert len(model["rules"]) <= 2
    rows = [(i, float(i % 10) if i % 7 else None, int(bool(i % 7) and i % 10 < 3)) for i in range(700)]
    some = spark.createDataFrame(rows, "id long, a double, label int")
    model = RP.fit_ripper(some, ["a"])
    assert model["rules"] and _accuracy(model, some) == 1.0
    none = RP.predict_ripper(model, some.where("a is null"))
    assert none.where("prediction = 1").count() == 0


def test_a_pass_over_packed_cells_counts_what_the_rows_say(spark):
    """Nulls, rows without an id or a label, several blocks."""
    rows = [(h, a, b, p, n) for h in (0, 5, 11, RP.NO_PART) for a in (0, 1, 2, RP.MISSING) for b in (0, 1) for p, n in ((h % 7, a % 5 + 1),)]
    cells = spark.createDataFrame(rows, "h int, a int, b int, p long, n long").repartition(3)
    learner = RP._Learner(cells.mapInArrow(RP._pack(2), "h binary, b binary, p binary, n binary"), ["a", "b"], {"a": [0.0, 1.0], "b": [0.0]}, 1 / 3)
    assert learner.total == (sum(r[3] for r in rows), sum(r[4] for r in rows))
    rule, other = [("a", ">", 0)], [("b", "<=", 0)]
    grow, held = learner.split([other])
    for part, inside in ((held, lambda h: h < 4), (grow, lambda h: 4 <= h < 12)):
        use = [r for r in rows if inside(r[0]) and r[2] > 0]
        assert learner.counts(part, [[()], [rule]]) == [(sum(r[3] for r in x), sum(r[4] for r in x)) for x in (use, [r for r in use if r[1] in (1, 2)])]
    alone = learner.counts(RP.ALL, [], [rule, other])
    want = [[r for r in rows if r[1] in (1, 2) and r[2] > 0], [r for r in rows if r[1] not in (1, 2) and r[2] == 0]]
    assert alone == [(sum(r[3] for r in x), sum(r[4] for r in x)) for x in want]
    whole, table = learner.histogram(RP.ALL, [])
    assert whole == learner.total and table[0, 1].tolist() == [sum(r[4] for r in rows if r[1] == k) for k in range(3)]
