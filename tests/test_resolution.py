"""Resolution of batches against a plain replay, row after row."""

import random
import re

import pytest
from pyspark.sql import functions as F

from basketry.operators import resolution as R
from basketry.operators import sequence as S
from basketry.operators.durable import cut


def plain(x):
    return " ".join(re.sub("[^a-z0-9]+", " ", x.lower().replace("&", " and ")).split())


def replay(batch, products, aliases):
    alias = dict(aliases)
    codes, made, out = {}, [], []
    for p in sorted(products, reverse=True):
        if p[3]:
            codes[p[3]] = p[0]
    for at, name, canonical, barcode, fresh in sorted(batch):
        n, c = plain(name), plain(canonical)
        if not n:
            continue
        exact = min(((-p[5], p[0]) for p in products if p[1].lower() == name.lower()), default=None)
        family = min(((-p[4], p[6], p[0]) for p in products if canonical.lower() in (p[1].lower(), (p[2] or "").lower())), default=None)
        if barcode in codes:
            found = codes[barcode], "barcode", 1.0, [n]
        elif n in alias:
            found = alias[n], "alias", 0.98, []
        elif exact:
            found = exact[1], "exact-name", 0.95, [n]
        elif c in alias:
            found = alias[c], "canonical-alias", 0.97, [n]
        elif family:
            found = family[2], "canonical", 0.95, [n, c]
        else:
            found = -1 - at, "created", 0.75 if barcode else fresh, [n, c]
            made.append(found[0])
            if barcode:
                codes[barcode] = found[0]
        alias |= dict.fromkeys(found[3], found[0])
        out.append((at, *found[:3]))
    return out, alias


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_are_a_replay(spark, seed):
    r = random.Random(seed)
    stems = ["milk", "red milk", "oat & milk", "tea", "green tea", "rice"]
    name = lambda: r.choice(["", "Acme ", "ACME  "]) + r.choice(stems) + r.choice(["", " 2L", "!"])
    code = lambda: r.choice([None, None, *"123456789"])
    batch = [(at * 7, name(), r.choice(stems).title(), code(), r.choice([0.5, 0.9])) for at in range(60)] + [(1001, " ! ", "Tea", "1", 0.5)]
    products = [(i, name(), r.choice([None, r.choice(stems)]), code(), float(r.randint(0, 2)), float(i % 4), float(i % 3)) for i in range(4)]
    aliases = [(plain(name()), 2), ("green tea 2l", 3)]
    aliases = list({k: (k, v) for k, v in aliases}.values())
    told, held = replay(batch, products, aliases)
    rows = spark.createDataFrame(batch, "at long, name string, canonical string, barcode string, fresh double").withColumns({"normalised": normalised(F.col("name")), "canonical_normalised": normalised(F.col("canonical"))})
    table = spark.createDataFrame(products, "id long, name string, canonical string, barcode string, confidence double, updated double, created double")
    known = spark.createDataFrame(aliases, "normalised string, product long")
    for parts, blocks in ((1, 1), (5, 4)):
        found, after = R.resolve(rows.repartition(parts), table, known, cut, blocks=blocks)
        assert sorted(map(tuple, found.collect())) == told
        assert {x["normalised"]: x["product"] for x in after.collect()} == held
    assert {"barcode", "alias", "created"} <= {x[2] for x in told}
    found, after = R.resolve(rows.limit(0), table, known, cut)
    assert found.collect() == []
    assert {x["normalised"]: x["product"] for x in after.collect()} == dict(aliases)


def normalised(c):
    from basketry.plans.resolution import normalised as n

    return n(c)


def test_gaps_are_filled_in_order(spark):
    products = spark.createDataFrame([(1, None, "x"), (2, "b", None)], "id long, barcode string, category string")
    batch = spark.createDataFrame([(5, "c", None), (3, "d", "y"), (9, "e", "z")], "at long, barcode string, category string")
    found = spark.createDataFrame([(5, 1), (3, 1), (9, -10)], "at long, product long")
    assert sorted(map(tuple, R.filled(batch, products, found, ["barcode", "category"]).collect())) == [(-10, "e", "z"), (1, "d", "x"), (2, "b", None)]


@pytest.mark.parametrize("blocks", [1, 3, 50])
def test_last_before_is_a_fold(spark, blocks):
    r = random.Random(3)
    data = [(r.choice("aab"), at, r.choice([None, at])) for at in range(90)]
    found = {(x["k"], x["at"]): x["out"] for x in S.last_before(spark.createDataFrame(data, "k string, at long, v long").repartition(4), "k", "at", F.col("v"), "out", blocks).collect()}
    last = {}
    for k, at, v in data:
        assert found[k, at] == last.get(k)
        if v is not None:
            last[k] = v
