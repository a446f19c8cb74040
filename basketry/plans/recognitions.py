"""Three recognitions of every order's receipt, made from its lines with things lost, and what is chosen and merged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketry.operators.recognitions import PACK, chosen
from basketry.plans.fixtures import table

TODAY = "1998-01-01"
#: Lines of orders in a part of them.
LINES = 150_000


def _recognitions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = F.col
    three = F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("candidate")
    # the place is the same for all candidates, so lines are dealt by receipt and numbered before they are repeated
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    bought = table(spark, sf_dir, "lineitem")
    # parts that a task sorts in memory, three times repeated
    parts = max(spark.sparkContext.defaultParallelism, bought.count() // LINES)
    lines = bought.join(table(spark, sf_dir, "part"), c("l_partkey") == c("p_partkey")).repartition(parts, "l_orderkey")
    placed = lines.withColumn("place", F.row_number().over(w))
    rows = placed.select(c("l_orderkey").alias("receipt"), three, "place", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", F.concat_ws(" ", "p_name", F.concat(c("p_size").cast("string"), F.lit("g"))).alias("description"))
    explicit = (c("l_suppkey") + c("candidate")) % 3 == 0
    items = rows.select("receipt", "candidate", "place", "description", F.when(explicit, c("l_quantity")).otherwise(1.0).alias("quantity"), F.when((c("l_partkey") + c("candidate")) % 5 != 0, c("l_extendedprice")).alias("price"), explicit.alias("explicit"))
    # orders are dealt by receipt before they are repeated too
    o, k = table(spark, sf_dir, "orders").repartition(parts, "o_orderkey"), c("o_orderkey")
    heads = o.select(k.alias("receipt"), three, "o_totalprice", "o_orderdate", "o_orderpriority", "o_custkey")
    i = c("candidate")
    return heads.select("receipt", "candidate", F.when((c("o_custkey") + i) % 6 != 0, c("o_orderpriority")).alias("retailer"), F.when((c("receipt") + i) % 7 != 0, c("o_totalprice") + F.when((c("o_custkey") + i) % 4 == 0, 1.0).otherwise(0.0)).alias("total"), F.when((c("receipt") + i) % 3 != 0, F.date_add(F.to_date("o_orderdate"), F.when(c("o_custkey") % 5 == i, 1).otherwise(0))).alias("date"), ((c("o_custkey") + i * 20) % 101).alias("sure"), ((c("receipt") + i * 30) % 120 - 10).alias("ocr"), (c("receipt") % 90 - i * 10).alias("structure"), ((c("o_custkey") + i) % 3).alias("warnings"), ((c("receipt") + i) % 8 == 0).alias("miscounted")), items


def chosen_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per receipt the candidate that is chosen, its score, and the date that most candidates bear out."""
    return chosen(*_recognitions(spark, sf_dir), F.lit(TODAY).cast("date"))[0]


def merged_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of the chosen candidates, with quantities and prices that others read."""
    return chosen(*_recognitions(spark, sf_dir), F.lit(TODAY).cast("date"))[1]


_TOKENS = "list_distinct(list_filter(string_split(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: length(t) > 1))"
_SQL = f"""
WITH items AS MATERIALIZED (SELECT l_orderkey AS receipt, k AS candidate, CAST(row_number() OVER (PARTITION BY l_orderkey, k ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS place, p_name || ' ' || p_size || 'g' AS description,
    CASE WHEN (l_suppkey + k) % 3 = 0 THEN l_quantity ELSE 1 END AS quantity, CASE WHEN (l_partkey + k) % 5 <> 0 THEN l_extendedprice END AS price, (l_suppkey + k) % 3 = 0 AS explicit FROM lineitem JOIN part ON l_partkey = p_partkey, range(3) x(k)),
heads AS (SELECT o_orderkey AS receipt, k AS candidate, CASE WHEN (o_custkey + k) % 6 <> 0 THEN o_orderpriority END AS retailer, CASE WHEN (o_orderkey + k) % 7 <> 0 THEN o_totalprice + CASE WHEN (o_custkey + k) % 4 = 0 THEN 1 ELSE 0 END END AS total,
    CASE WHEN (o_orderkey + k) % 3 <> 0 THEN CAST(CAST(o_orderdate AS DATE) + CAST(CASE WHEN o_custkey % 5 = k THEN 1 ELSE 0 END AS INT) AS DATE) END AS day, (o_custkey + k * 20) % 101 AS sure, (o_orderkey + k * 30) % 120 - 10 AS ocr, o_orderkey % 90 - k * 10 AS structure, (o_custkey + k) % 3 AS warnings, (o_orderkey + k) % 8 = 0 AS miscounted FROM orders, range(3) x(k)),
counts AS (SELECT receipt, candidate, count(*) AS n, count(*) FILTER (explicit) AS told, count(*) FILTER (price IS NULL) AS unpriced FROM items GROUP BY ALL),
scored AS MATERIALIZED (SELECT h.*, coalesce(n, 0) AS n, sure * 2 + least(coalesce(n, 0), 25) * 8 + CASE WHEN retailer IS NULL THEN 0 ELSE 12 END + CASE WHEN day IS NULL THEN 0 ELSE 12 END + CASE WHEN total IS NULL THEN -120 ELSE 35 END + coalesce(told, 0) * 20 - coalesce(unpriced, 0) * 18 + greatest(0, least(100, ocr)) + structure - warnings * 55 AS score
  FROM heads h LEFT JOIN counts USING (receipt, candidate)),
best AS MATERIALIZED (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY receipt ORDER BY (retailer IS NOT NULL AND total IS NOT NULL AND n >= 3 AND NOT miscounted) DESC, score DESC, candidate) = 1),
same AS MATERIALIZED (SELECT s.*, coalesce(abs(s.total - b.total) <= 0.05 AND s.n = b.n, false) AS alike FROM scored s JOIN best b ON s.receipt = b.receipt AND s.retailer IS NOT DISTINCT FROM b.retailer AND NOT coalesce(abs(s.total - b.total) > 0.05, false))"""
_ITEMS = f"""{_SQL},
kept AS (SELECT i.*, {_TOKENS.format("i.description")} AS w FROM items i JOIN best b USING (receipt, candidate)),
told AS (SELECT i.*, s.score, s.alike, {_TOKENS.format("i.description")} AS w FROM items i JOIN same s USING (receipt, candidate)),
q AS (SELECT k.receipt, k.place, t.quantity FROM kept k JOIN told t ON k.receipt = t.receipt AND t.explicit AND ((t.alike AND t.place = k.place) OR (len(list_intersect(k.w, t.w)) >= 3 AND len(list_filter(list_intersect(k.w, t.w), lambda x: regexp_matches(x, '{PACK}'))) > 0)) WHERE NOT k.explicit
  QUALIFY row_number() OVER (PARTITION BY k.receipt, k.place ORDER BY t.score DESC, CASE WHEN t.alike AND t.place = k.place THEN 0 ELSE 1 END, t.candidate, t.place) = 1),
p AS (SELECT receipt, place, price FROM told WHERE alike AND price IS NOT NULL QUALIFY row_number() OVER (PARTITION BY receipt, place ORDER BY score DESC, candidate) = 1)
SELECT k.receipt, k.place, k.description, coalesce(q.quantity, k.quantity) AS quantity, coalesce(k.price, p.price) AS price FROM kept k LEFT JOIN q ON k.receipt = q.receipt AND k.place = q.place LEFT JOIN p ON k.receipt = p.receipt AND k.place = p.place"""

QUERIES = {
    "chosen_receipts": (chosen_receipts, f"""{_SQL}, days AS (SELECT receipt, day, count(*) AS k, max(score) AS s FROM same WHERE day <= DATE '{TODAY}' GROUP BY receipt, day QUALIFY row_number() OVER (PARTITION BY receipt ORDER BY count(*) DESC, max(score) DESC, day DESC) = 1)
SELECT b.receipt, CAST(b.candidate AS INT) AS candidate, b.score, d.day AS "date" FROM best b LEFT JOIN days d ON b.receipt = d.receipt"""),
    "merged_items": (merged_items, _ITEMS),
}
