"""A batch of names resolved against a catalogue that it changes, as if row after row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.operators import resolution as R
from basketry.operators.durable import cut
from basketry.plans.fixtures import table


def normalised(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "&", " and "), "[^a-z0-9]+", " "))


def _batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as a row that says a name: plain, behind its brand, or in capitals behind its type; some have a code, which several share."""
    c = F.col
    name = F.when(c("p_size") % 3 == 0, c("p_name")).when(c("p_size") % 3 == 1, F.concat_ws(" ", "p_brand", "p_name")).otherwise(F.upper(F.concat_ws(" & ", "p_type", "p_name")))
    canonical = F.when(c("p_size") > 25, F.concat("p_name", F.lit(" Large"))).otherwise(c("p_name"))
    code = F.when(c("p_size") % 4 == 0, F.concat(F.lit("9"), (F.floor(c("p_retailprice") * 10) % 300).cast("string")))
    rows = table(spark, sf_dir, "part").select(c("p_partkey").alias("at"), name.alias("name"), canonical.alias("canonical"), code.alias("barcode"), F.when(c("p_name").startswith("red"), 0.9).otherwise(0.5).alias("fresh"), F.nullif(c("p_type"), F.lit("SMALL")).alias("category"))
    return rows.withColumns({"normalised": normalised(c("name")), "canonical_normalised": normalised(c("canonical"))})


def _catalogue(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Known products: those of one brand; and aliases: another brand's names, where a known product has the name."""
    c = F.col
    parts = table(spark, sf_dir, "part")
    own = parts.filter("p_brand = 'Brand#11'")
    products = own.select(c("p_partkey").alias("id"), F.when(c("p_size") % 2 == 0, c("p_name")).otherwise(F.concat_ws(" ", "p_brand", "p_name")).alias("name"), F.when(c("p_size") % 5 > 0, c("p_name")).alias("canonical"), F.when(c("p_size") % 3 == 0, F.concat(F.lit("9"), (F.floor(c("p_retailprice") * 10) % 300).cast("string"))).alias("barcode"), (c("p_size") % 10).cast("double").alias("confidence"), c("p_retailprice").alias("updated"), (-c("p_retailprice")).alias("created"), F.when(c("p_size") > 30, c("p_type")).alias("category"))
    named = own.groupBy("p_name").agg(F.min("p_partkey").alias("product"))
    aliases = parts.filter("p_brand = 'Brand#12'").select("p_name", normalised(F.concat_ws(" ", "p_brand", "p_name")).alias("normalised")).distinct().join(named, "p_name").select("normalised", "product")
    return products, aliases


def resolved_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's product, why, and how sure; rows that create something are negative products."""
    found, _ = R.resolve(_batch(spark, sf_dir), *_catalogue(spark, sf_dir), cut)
    return found


def resolved_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The aliases that hold after the batch."""
    return R.resolve(_batch(spark, sf_dir), *_catalogue(spark, sf_dir), cut)[1].select("normalised", "product")


def resolved_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The products after the batch: code and category, their gaps filled from the rows in their order."""
    batch, (products, aliases) = _batch(spark, sf_dir), _catalogue(spark, sf_dir)
    found, _ = R.resolve(batch, products, aliases, cut)
    return R.filled(batch, products, found, ["barcode", "category"])


_NORMALISED = "trim(regexp_replace(replace(lower({0}), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"
_CODE = "'9' || CAST(CAST(floor(p_retailprice * 10) AS BIGINT) % 300 AS VARCHAR)"
#: Row after row: the state is the map of aliases and that of codes.
REPLAY = f"""
WITH RECURSIVE raw AS (SELECT p_partkey AS "at", CASE p_size % 3 WHEN 0 THEN p_name WHEN 1 THEN p_brand || ' ' || p_name ELSE upper(p_type || ' & ' || p_name) END AS name,
    CASE WHEN p_size > 25 THEN p_name || ' Large' ELSE p_name END AS canonical, CASE WHEN p_size % 4 = 0 THEN {_CODE} END AS barcode, CASE WHEN starts_with(p_name, 'red') THEN 0.9 ELSE 0.5 END AS fresh, nullif(p_type, 'SMALL') AS category FROM part),
products AS (SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_brand || ' ' || p_name END AS name, CASE WHEN p_size % 5 > 0 THEN p_name END AS canonical, CASE WHEN p_size % 3 = 0 THEN {_CODE} END AS barcode,
    p_size % 10 AS confidence, p_retailprice AS updated, CASE WHEN p_size > 30 THEN p_type END AS category FROM part WHERE p_brand = 'Brand#11'),
known AS (SELECT {_NORMALISED.format("p_brand || ' ' || p_name")} AS k, min(o.id) AS product FROM part JOIN (SELECT p_name AS n, p_partkey AS id FROM part WHERE p_brand = 'Brand#11') o ON n = p_name WHERE p_brand = 'Brand#12' GROUP BY 1),
batch AS MATERIALIZED (SELECT row_number() OVER (ORDER BY "at") AS i, *, {_NORMALISED.format("name")} AS n, {_NORMALISED.format("canonical")} AS c,
  (SELECT arg_max(p.id, (p.updated, -p.id)) FROM products p WHERE lower(p.name) = lower(raw.name)) AS exact,
  (SELECT arg_max(p.id, (p.confidence, p.updated, -p.id)) FROM products p WHERE lower(p.name) = lower(raw.canonical) OR lower(p.canonical) = lower(raw.canonical)) AS family FROM raw),
state(i, "at", product, reason, confidence, aliases, codes) AS (
  SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), '', CAST(NULL AS DOUBLE), (SELECT map(list(k), list(product)) FROM known), (SELECT map(list(barcode), list(id)) FROM (SELECT barcode, min(id) AS id FROM products WHERE barcode IS NOT NULL GROUP BY barcode))
  UNION ALL
  SELECT i, "at", product, reason, CASE reason WHEN 'barcode' THEN 1 WHEN 'alias' THEN 0.98 WHEN 'exact-name' THEN 0.95 WHEN 'canonical-alias' THEN 0.97 WHEN 'canonical' THEN 0.95 ELSE CASE WHEN barcode IS NULL THEN fresh ELSE 0.75 END END,
    CASE WHEN reason = 'alias' THEN aliases WHEN reason IN ('canonical', 'created') THEN map_concat(aliases, CASE WHEN n = c THEN map([n], [product]) ELSE map([n, c], [product, product]) END) ELSE map_concat(aliases, map([n], [product])) END,
    CASE WHEN reason = 'created' AND barcode IS NOT NULL THEN map_concat(codes, map([barcode], [product])) ELSE codes END
  FROM (SELECT *, CASE reason WHEN 'barcode' THEN by_code WHEN 'alias' THEN by_alias WHEN 'exact-name' THEN exact WHEN 'canonical-alias' THEN by_family WHEN 'canonical' THEN family ELSE -1 - "at" END AS product
    FROM (SELECT *, CASE WHEN by_code IS NOT NULL THEN 'barcode' WHEN by_alias IS NOT NULL THEN 'alias' WHEN exact IS NOT NULL THEN 'exact-name' WHEN by_family IS NOT NULL THEN 'canonical-alias' WHEN family IS NOT NULL THEN 'canonical' ELSE 'created' END AS reason
      FROM (SELECT b.*, s.aliases, s.codes, map_extract(s.codes, b.barcode)[1] AS by_code, map_extract(s.aliases, b.n)[1] AS by_alias, map_extract(s.aliases, b.c)[1] AS by_family FROM state s JOIN batch b ON b.i = s.i + 1))))"""

QUERIES = {
    "resolved_batch": (resolved_batch, f"""{REPLAY} SELECT "at", product, reason, confidence FROM state WHERE i > 0"""),
    "resolved_aliases": (resolved_aliases, f"{REPLAY} SELECT unnest(map_keys(aliases)) AS normalised, unnest(map_values(aliases)) AS product FROM state WHERE i = (SELECT max(i) FROM state)"),
    "resolved_catalogue": (resolved_catalogue, f"""{REPLAY}, given AS (SELECT s.product AS id, arg_min(b.barcode, b."at") FILTER (b.barcode IS NOT NULL) AS barcode, arg_min(b.category, b."at") FILTER (b.category IS NOT NULL) AS category FROM state s JOIN batch b ON s.i = b.i GROUP BY s.product)
SELECT coalesce(p.id, g.id) AS id, coalesce(p.barcode, g.barcode) AS barcode, coalesce(p.category, g.category) AS category FROM products p FULL JOIN given g ON p.id = g.id"""),
}
