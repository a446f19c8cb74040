"""The domain's entities over the synthetic tables, as DataFrames and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.functions import numbers as N
from basketry.operators.durable import spread as spread

#: All that depends on the time of day is asked as of this moment.
AS_OF = "1998-09-01 12:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def measured() -> tuple[Column, Column]:
    """The quantity and the unit of a line of an order."""
    units = F.array(*[F.lit(u) for u in ("kg", "g", "l", "ml", "item")])
    return F.nullif(F.col("l_quantity"), F.lit(50.0)), F.get(units, F.col("l_linenumber").cast("int") % 5)


def items(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Receipt items: a line of an order with its receipt, product and retailer; the columns named, or all.

    Only tables that a column comes from are joined: an inner join can't be left out by the optimiser.
    """
    joined = table(spark, sf_dir, "lineitem")
    quantity, unit = measured()
    known = {
        "item_id": F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.floor(F.col("l_extendedprice") * 100 + 0.5)),
        "receipt_id": F.col("l_orderkey"),
        "line": F.col("l_linenumber").cast("int"),
        "product_id": F.col("l_partkey"),
        "product": F.col("p_name"),
        "brand": F.col("p_brand"),
        "retailer": F.col("s_name"),
        "bought": F.to_date("o_orderdate"),
        "seen": F.to_date("l_shipdate"),
        "price": F.col("l_extendedprice"),
        "quantity": quantity,
        "unit": unit,
        "is_food": F.when(F.col("l_returnflag") == "A", True).when(F.col("l_returnflag") == "R", False),
        "status": F.when(F.col("o_orderstatus") == "F", "IMPORTED").when(F.col("o_orderstatus") == "O", "DRAFT").otherwise("CANCELLED"),
        "is_special": F.col("l_discount") >= 0.05,
        "shelf_days": F.col("p_size").cast("int"),
        "printed_total": F.col("o_totalprice"),
    }
    wanted = columns or tuple(known)
    for name, key, other, own in (("orders", "l_orderkey", "o_orderkey", ("bought", "status", "printed_total")), ("part", "l_partkey", "p_partkey", ("product", "brand", "shelf_days")), ("supplier", "l_suppkey", "s_suppkey", ("retailer",))):
        if set(own) & set(wanted):
            joined = joined.join(table(spark, sf_dir, name), F.col(key) == F.col(other))
    return joined.select(*[known[c].alias(c) for c in wanted])


ITEMS = """items AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)) AS item_id,
    l_orderkey AS receipt_id, CAST(l_linenumber AS INT) AS line, p_partkey AS product_id, p_name AS product, p_brand AS brand, s_name AS retailer,
    CAST(o_orderdate AS DATE) AS bought, CAST(l_shipdate AS DATE) AS seen, l_extendedprice AS price, nullif(l_quantity, 50) AS quantity,
    (['kg', 'g', 'l', 'ml', 'item'])[CAST(l_linenumber AS INT) % 5 + 1] AS unit,
    CASE l_returnflag WHEN 'A' THEN true WHEN 'R' THEN false END AS is_food,
    CASE o_orderstatus WHEN 'F' THEN 'IMPORTED' WHEN 'O' THEN 'DRAFT' ELSE 'CANCELLED' END AS status,
    l_discount >= 0.05 AS is_special, CAST(p_size AS INT) AS shelf_days, o_totalprice AS printed_total
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"""

MONEY = "floor(({0} + 2.220446049250313e-16) * 100 + 0.5)"


def priced(rows: DataFrame) -> DataFrame:
    """Items with their comparable price, in whole cents, and its label."""
    p = N.comparable_price(F.col("price"), F.col("quantity"), F.col("unit"))
    return rows.withColumn("p", p).withColumns({"cents": N.cents(F.col("p.price")), "label": F.col("p.label")}).drop("p")


PRICED = f"""priced AS (
  SELECT *, CAST({MONEY.format("CASE unit WHEN 'kg' THEN price / (q * 1000) * 100 WHEN 'g' THEN price / q * 100 WHEN 'ml' THEN price / q * 1000 ELSE price / q END")} AS BIGINT) AS cents,
    CASE WHEN unit IN ('kg', 'g') THEN 'per 100 g' WHEN unit IN ('l', 'ml') THEN 'per L' ELSE 'per ' || unit END AS label
  FROM (SELECT *, CASE WHEN quantity > 0 THEN quantity ELSE 1 END AS q FROM items))"""
