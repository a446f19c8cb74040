"""Choice among recognitions of a receipt: known cases; all pairs are in the queries' SQL."""

import datetime

from pyspark.sql import functions as F

from basketry.operators.recognitions import chosen

HEADS = "receipt long, candidate int, retailer string, total double, date date, sure int, ocr int, structure int, warnings int, miscounted boolean"
ITEMS = "receipt long, candidate int, place int, description string, quantity double, price double, explicit boolean"
DAY, LATER = datetime.date(2026, 8, 9), datetime.date(2026, 8, 10)


def pick(spark, heads, items):
    best, merged = chosen(spark.createDataFrame(heads, HEADS).repartition(3), spark.createDataFrame(items, ITEMS).repartition(3), F.lit("2026-12-31").cast("date"))
    return sorted(map(tuple, best.collect())), sorted(map(tuple, merged.collect()))


def test_others_fill_what_the_best_lacks(spark):
    heads = [(1, 0, "coles", 35.6, LATER, 100, 90, 50, 0, False), (1, 1, "coles", 35.62, DAY, 60, 60, 0, 0, False), (1, 2, "coles", None, DAY, 20, 20, 0, 1, False), (1, 3, "aldi", 35.6, DAY, 10, 10, 0, 0, False)]
    items = [(1, 0, 1, "Pepsi Max Cola 1l", 1.0, 16.0, False), (1, 0, 2, "Raw Sugar 2kg", 1.0, None, False), (1, 0, 3, "Bread", 2.0, 4.0, True), (1, 0, 4, "Tea", 1.0, 1.0, False)]
    items += [(1, 1, 1, "x", 1.0, 9.0, False), (1, 1, 2, "y", 3.0, 3.2, True), (1, 1, 3, "z", 5.0, 4.0, True), (1, 1, 4, "w", 1.0, 1.0, False)]
    # other numbers of items: by name only; another retailer tells nothing
    items += [(1, 2, 7, "PEPSI max cola 1L", 4.0, 4.0, True), (1, 3, 4, "Tea", 9.0, 9.0, True)]
    best, merged = pick(spark, heads, items)
    assert [(b[0], b[1], b[3]) for b in best] == [(1, 0, DAY)]
    assert merged == [(1, 1, "Pepsi Max Cola 1l", 4.0, 16.0), (1, 2, "Raw Sugar 2kg", 3.0, 3.2), (1, 3, "Bread", 2.0, 4.0), (1, 4, "Tea", 1.0, 1.0)]


def test_ties_and_gaps(spark):
    heads = [(1, 1, None, None, None, 5, 5, 0, 0, False), (1, 0, None, None, None, 5, 5, 0, 0, False), (2, 0, "coles", 3.0, datetime.date(2027, 1, 1), 1, 1, 0, 0, True)]
    best, merged = pick(spark, heads, [(2, 0, 1, None, 1.0, None, False)])
    assert [(b[0], b[1], b[3]) for b in best] == [(1, 0, None), (2, 0, None)]
    assert merged == [(2, 1, None, 1.0, None)]
    # a usable one goes before one with a better score
    heads = [(1, 0, "coles", 3.0, DAY, 1, 1, 0, 0, False), (1, 1, "coles", 3.0, DAY, 100, 100, 90, 0, True)]
    items = [(1, k, p, f"item {p}", 1.0, 1.0, False) for k in (0, 1) for p in (1, 2, 3)]
    assert [b[1] for b in pick(spark, heads, items)[0]] == [0]


def test_what_is_said_of_receipts_is_dealt_by_receipt_only(spark):
    from basketry.plans import queries

    plan = queries()["merged_items"][0](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    # orders and lines by receipt, and before that lines and products by product, where these aren't sent to all
    assert plan.count("Exchange hashpartitioning(") <= 4 and "pack" not in plan.replace("pack)$", "")
