"""Queries over all rows, on small tables that the narrower ones would lose rows of."""

import datetime
import json
from collections import defaultdict

import pytest

from basketry.plans import household, prices, stock

DAY = datetime.datetime(1990, 1, 1)


@pytest.fixture(scope="module")
def shops(spark, tmp_path_factory):
    """1,400 orders, each of one line and the last ones of two."""
    at = str(tmp_path_factory.mktemp("shops"))
    names, brands = ["red apple", "red apples", "oat milk", "green tea"], ["A", "B"]
    spark.createDataFrame([(i, "OF"[i % 2], 10.0, DAY + datetime.timedelta(i)) for i in range(1400)], "o_orderkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp").write.parquet(f"{at}/orders.parquet")
    lines = [(i, 1, i % 4 if i >= 300 else 3, i % 2 if i >= 20 else 2) for i in range(1400)] + [(i, 2, (i + 1) % 4, 1) for i in range(1390, 1400)]
    rows = [(o, n, p, s, 1.0 + o % 7, 1.0 + (o * 13 + n) % 97 / 4, 0.0, "A", DAY + datetime.timedelta(o + 3)) for o, n, p, s in lines]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_returnflag string, l_shipdate timestamp").write.parquet(f"{at}/lineitem.parquet")
    spark.createDataFrame([(i, n, brands[i % 2], 5) for i, n in enumerate(names)], "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(f"{at}/part.parquet")
    spark.createDataFrame([(i, f"shop {i}", i) for i in range(3)], "s_suppkey long, s_name string, s_nationkey int").write.parquet(f"{at}/supplier.parquet")
    # each shop is a retailer of its own
    spark.createDataFrame([(i, f"shop {i}") for i in range(3)], "n_nationkey int, n_name string").write.parquet(f"{at}/nation.parquet")
    return at, names, brands, rows


def test_baskets_of_all_open_orders(spark, shops):
    at, names, _, rows = shops
    # scores of these names, by hand: red apple and red apples hold each other, the others match themselves alone
    score = {(a, b): 100 if a == b else 85 if {a, b} == set(names[:2]) else 0 for a in names for b in names}
    offer = defaultdict(lambda: 10**9)
    for _, _, p, s, _, price, *_ in rows:
        offer[s, names[p]] = min(offer[s, names[p]], round(price * 100))
    told = {}
    for o, n, p, _, q, *_ in rows:
        for s in range(3) if o % 2 == 0 else ():
            best = min(((-score[names[p], b], cents, b) for (at_shop, b), cents in offer.items() if at_shop == s and score[names[p], b]), default=None)
            if best:
                total, matched = told.get((o, f"shop {s}"), (0, 0))
                # lines 1 and 2 are by g and l: never by the item, so that the quantity doesn't multiply
                told[o, f"shop {s}"] = (total + best[1], matched + 1)
    size = defaultdict(int)
    for o, *_ in rows:
        size[o] += 1
    got = {(r.list_id, r.retailer): (round(r.total * 100), r.matched, r.missing) for r in prices.basket_all(spark, at).collect()}
    assert got == {k: (t, m, size[k[0]] - m) for k, (t, m) in told.items()}
    assert {k[0] for k in got} == set(range(0, 1400, 2)) and prices.basket(spark, at).count() == len(got)


def test_newest_of_all_rows(spark, shops):
    at, names, brands, rows = shops
    told = {}
    for o, n, p, s, _, price, _, _, seen in rows:
        key = f"shop {s}", names[p], brands[p % 2]
        told[key] = max(told.get(key, (seen, o, n)), (seen, o, n))
    got = {(r.retailer, r["product"], r.brand): tuple(map(int, r.item_id.split("-")[:2])) for r in prices.newest_prices_all(spark, at).collect()}
    assert got == {k: (o, n) for k, (_, o, n) in told.items()}
    # shop 2 sold nothing but what came first: the 1,000 newest rows don't know it
    assert ("shop 2", "green tea", "B") in got and "shop 2" not in {r.retailer for r in prices.newest_prices(spark, at).collect()}


def test_pivot_counts_all_events(spark, tmp_path):
    types = ["click", "error", "purchase", "signup", "view", "refund", None]
    rows = [(i, DAY + datetime.timedelta(hours=i), i % 3, types[i % 7], '{"k": 1}') for i in range(500)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, props string").write.parquet(f"{tmp_path}/events.parquet")
    told = defaultdict(int)
    for _, ts, user, kind, _ in rows:
        told[user, ts.date(), kind if kind in types[:5] else "other"] += 1
    got = household.event_pivot_all(spark, str(tmp_path)).collect()
    columns = [*types[:5], "other"]
    assert {(r.user_id, r.day, c): r[c] for r in got for c in columns if r[c]} == told
    assert sum(r[c] for r in got for c in columns) == 500


def test_document_sink(spark, tmp_path):
    stock.write_catalogue(spark, "/root/testdata/sf0.001", str(tmp_path / "out"))
    documents = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert len(documents) == 200 and sum(s["lines"] for d in documents for s in d["suppliers"]) == 6000
    assert all(d["suppliers"] == sorted(d["suppliers"], key=lambda s: s["supplier"]) for d in documents)
