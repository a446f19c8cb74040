"""Steps that SQL can't say, against plain Python."""

import datetime

import numpy as np
from pyspark.sql import functions as F

from basketry.functions import names as M
from basketry.operators import relational as R

START = datetime.datetime(2024, 1, 1)


def test_stored_observations_is_the_chain(spark):
    rng = np.random.default_rng(2)
    rows = [(int(rng.integers(3)), START + datetime.timedelta(minutes=int(m)), int(rng.integers(3)) if rng.random() < 0.9 else None) for m in rng.choice(20_000, 300, replace=False)]
    told, last = [], {}
    for key, at, v in sorted(rows, key=lambda r: r[1]):
        before = last.get(key)
        if before is None or before[1] != v or (at - before[0]).total_seconds() >= 6 * 3600:
            last[key] = (at, v)
            told.append((key, at, v))
    got = R.stored_observations(spark.createDataFrame(rows, "k int, at timestamp_ntz, v int"), "k", "at", ["v"])
    assert sorted(map(tuple, got.select("k", "at", "v").collect()), key=str) == sorted(told, key=str)


def test_until_stable(spark):
    rows = spark.createDataFrame([("a a a a",), ("b",), ("c c",)], "t string")
    calls = []

    def step(df):
        calls.append(1)
        return df.select(F.regexp_replace("t", r"^(\w) \1", "$1").alias("t")).distinct()

    got = R.until_stable(rows, step, lambda df: df.cache())
    assert sorted(r.t for r in got.collect()) == ["a", "b", "c"] and len(calls) == 4
    assert [r.t for r in R.until_stable(rows.limit(0), step, lambda df: df.cache()).collect()] == []


def test_longest_phrase(spark):
    rows = spark.createDataFrame([(1, "big red apple pie"), (2, "redapple"), (3, ""), (4, "apple red apple")], "k int, t string")
    phrases = spark.createDataFrame([("apple", 0), ("red apple", 1), ("apple pie", 2), ("big", 3)], "phrase string, rank int")
    assert sorted(map(tuple, R.contained_phrases(rows, "k", "t", phrases).collect())) == [(1, "red apple"), (4, "red apple")]


# Lines of recipes, and the name, amount and unit that they mean.
LINES = [
    ("2 cups basmati rice", ("Basmati Rice", 2.0, "cups")),
    ("400 g can chopped tomatoes, drained", ("Tomato", 1.0, "can")),
    ("2 x 400 g tins chickpeas", ("Chickpea", 2.0, "tin")),
    ("1-2 kg potatoes", ("Potato", 2.0, "kg")),
    ("3 cloves of garlic", ("Garlic", 3.0, "each")),
    ("500 g beef mince or lamb", ("Beef Mince", 500.0, "g")),
    ("For the sauce:", ("", None, None)),
    ("to serve", ("", None, None)),
]


def test_ingredient_lines(spark):
    got = {r.t: tuple(r.ingredient) for r in M.ingredients(spark.createDataFrame([(t,) for t, _ in LINES] + [(None,)], "t string"), "t").collect()}
    assert {t: got[t] for t, _ in LINES} == dict(LINES)
    assert got[None] == ("", None, None)
