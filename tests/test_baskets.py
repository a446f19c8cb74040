"""Baskets of lists at retailers: against brute force, in small bundles and blocks."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from basketry.operators import baskets as B
from basketry.plans import queries, texts

DATA = "/root/testdata/sf0.001"


def made(r, most):
    wanted = [(r.choice([1, 2, 3, 4, 5, 6, 7, None]), r.choice(["a", "b", "c", "d", "e", None]), r.choice([1, 1, 3, most])) for _ in range(40)] + [(8, "a", 1), (9, "e", 1)]
    prices = [(w, s, r.choice([None, 0, 5, 7, 7, most])) for w in "abcd" for s in ("x", "y", "Z", "é", "😀", "z") if r.random() < 0.7] + [("a", "all", 5), ("b", "all", 6), ("c", "all", 7), ("d", "all", None)]
    return wanted, prices


def brute(wanted, prices):
    lists, price, got = defaultdict(list), {(w, s): c for w, s, c in prices}, {}
    for i, w, times in wanted:
        if i is not None:
            lists[i].append((w, times))
    for i, rows in lists.items():
        for s in {s for _, s, _ in prices}:
            hits = [(price[w, s], times) for w, times in rows if (w, s) in price]
            if hits:
                told = [c * times for c, times in hits if c is not None]
                got[i, s] = (sum(told) if told else None, len(hits), len(rows) - len(hits))
    return got


def test_baskets_are_those_of_all_pairs(spark, monkeypatch):
    for seed, most in ((1, 9), (2, 9), (3, 2**40)):
        wanted, prices = made(random.Random(seed), most)
        told = brute(wanted, prices)
        for wide, cells, lists in ((1024, 1 << 20, 1), (2, 8, 600), (3, 1, 2000)):
            monkeypatch.setattr(B, "WIDE", wide), monkeypatch.setattr(B, "CELLS", cells)
            some = B.bundles(spark.createDataFrame(wanted, "list_id long, wanted string, times long"), lists)
            at = spark.createDataFrame(prices, "wanted string, retailer string, cents long")
            got = {(x.list_id, x.retailer): (x.total, x.matched, x.missing) for x in B.baskets(some, at).collect()}
            assert got == {k: (None if t is None else t / 100, n, m) for k, (t, n, m) in told.items()}
            if most < 2**40:
                ends = {x.list_id: (x.retailer, x.cents, x.dearest, x.complete) for x in B.whole_baskets(some, at).collect()}
                whole = defaultdict(list)
                for (i, s), (t, _, m) in told.items():
                    if m == 0:
                        whole[i].append((t is None, t or 0, s.encode()))
                assert ends == {i: (min(x)[2].decode(), *((None, None) if min(x)[0] else (min(x)[1], max(t for no, t, _ in x if not no))), len(x)) for i, x in whole.items()} and ends


def test_pairs_of_lists_and_retailers_are_not_shuffled(spark):
    for name in ("basket", "basket_all"):
        plan = queries_plan(spark, name)
        assert "CartesianProduct" in plan and "hashpartitioning(list_id" not in plan and "Broadcast" not in plan


def queries_plan(spark, name):
    return queries()[name][0](spark, DATA)._jdf.queryExecution().executedPlan().toString()


def test_suppliers_of_one_name_count_once(spark, tmp_path):
    at = str(tmp_path)
    for name in ("orders", "lineitem", "part", "nation"):
        spark.read.parquet(f"{DATA}/{name}.parquet").write.parquet(f"{at}/{name}.parquet")
    suppliers = spark.read.parquet(f"{DATA}/supplier.parquet")
    # of the same name, and of the nation of the first of them
    same = suppliers.withColumns({"s_name": F.lit("one"), "s_nationkey": F.lit(3).cast(suppliers.schema["s_nationkey"].dataType)})
    same.write.parquet(f"{at}/supplier.parquet")
    got = texts.basket_summary(spark, at).collect()
    assert got and all(x.complete == 1 and x.saves == 0 for x in got)
    lines = {x.l_orderkey: x.n for x in spark.read.parquet(f"{at}/lineitem.parquet").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n")).collect()}
    whole = queries()["basket_all"][0](spark, at).collect()
    assert all(x.matched == lines[x.list_id] and x.missing == 0 for x in whole) and {x.list_id: x.total for x in whole} == {x.list_id: x.total for x in got}


def test_lists_are_taken_in_steps_of_some_prices(monkeypatch):
    import numpy as np
    import pyarrow as pa

    r = random.Random(4)
    items = pa.array([{"list_id": r.randrange(30), "wanted": r.choice(["a", "b", "c", "none", None]), "times": r.randrange(3), "n": r.randrange(1, 3)} for _ in range(300)], pa.struct([("list_id", pa.int64()), ("wanted", pa.string()), ("times", pa.int64()), ("n", pa.int64())]))
    price, has = np.arange(12).reshape(3, 4), np.array([[1, 0, 2, 1], [1, 1, 1, 0], [0, 0, 1, 1]], np.int8)
    price = price * (has == 1)

    def told():
        return {i: x for ids, *rest in B._steps(items, pa.array(["a", "b", "c"]), price, has) for i, *x in zip(ids.to_pylist(), *(y.tolist() for y in rest), strict=True)}

    at_once = told()
    monkeypatch.setattr(B, "CELLS", 40)
    assert told() == at_once and len(at_once) > 20
