"""Text and number functions over names and pages derived from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.functions import names as M
from basketry.functions import numbers as N
from basketry.functions import scores as S
from basketry.functions import text as T
from basketry.operators import relational as R
from basketry.plans.fixtures import items, spread, table
from basketry.plans.grocery import _LIST, GOODS_SQL, goods
from basketry.plans.prices import CHAINS_SQL, whole_chain_baskets


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: its distinct lines of text, their number and a fingerprint that case and outer blanks don't change."""
    lines = table(spark, sf_dir, "pages").select("page_id", T.html_lines(F.coalesce("html", F.lit(""))).alias("l"))
    return lines.select("page_id", F.size("l").alias("lines"), F.md5(F.array_join("l", "\n")).alias("text_md5"))


def line_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of receipts: SHA-256 of their lines, trimmed and in lower case; receipts that have the same one."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.concat(F.lit(" Part "), F.col("l_partkey").cast("string"), F.lit(" ")))).alias("l"))
    return rows.select("l_orderkey", N.fingerprint(F.col("l")).alias("fingerprint"))


def name_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per listed name: as a title, with spaced measures, as a query, and three normal forms that differ in full stops, ampersands and apostrophes."""
    k = F.col("id")
    listed = F.when(k % 3 == 0, F.concat_ws(" ", "brand", F.lit("o'"), "name", F.lit("& co 1.5kg,"))).otherwise(F.concat("name", F.lit(" of the <b>/2kg!"), "stored"))
    g = goods(spark, sf_dir).select(k, listed.alias("x")).filter("x is not null")
    c = F.col("x")
    return g.select("id", T.title_case(c).alias("title"), T.spaced_measures(c).alias("spaced"), T.search_query(c, 30).alias("query"), T.normalise(c).alias("with_dots"), T.normalise(c, False, False).alias("bare"), S.plain(c).alias("spelled"))


def likeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per product: how much its name is like that of the next one, by letters and by words."""
    g = goods(spark, sf_dir).select("id", F.lower("name").alias("a"))
    two = g.join(g.select((F.col("id") - 1).alias("id"), F.col("a").alias("b")), "id")
    return two.select("id", N.round_half_up(T.similarity(F.col("a"), F.col("b")), 6).alias("letters"), N.round_half_up(T.coverage(F.col("a"), F.col("b")), 6).alias("words"))


def said_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices, fractions, durations and pack sizes as they are written, read; the unit's usual name."""
    k, n = F.col("p_partkey"), F.col("p_size")
    money = F.when(k % 4 == 0, F.concat(F.lit("$"), n.cast("string"), F.lit("."), F.lpad((k % 200 * 5).cast("string"), 3, "0"), F.lit(" ea"))).when(k % 4 == 1, F.lit("free")).otherwise(n.cast("string"))
    part = F.when(k % 3 == 0, F.concat(n.cast("string"), F.lit(" 1/2"))).when(k % 3 == 1, F.lit("½")).otherwise(F.lit("some"))
    time = F.when(k % 5 != 0, F.concat(F.lit("PT"), n.cast("string"), F.lit("H15M"))).otherwise("soon")
    packs = F.array(*[F.lit(x) for x in ("2 L", "500 g", "1.5 kg", "12 pack", "6 pk", "750 ml")])
    unit = F.get(F.array(*[F.lit(x) for x in ("Grams", "litre", "ea", "Kilograms", "bunch")]), (k % 5).cast("int"))
    return spread(table(spark, sf_dir, "part").select(k, n)).select(k, N.parse_price(money).alias("price"), N.parse_fraction(part).alias("amount"), N.iso_minutes(time).alias("minutes"), S.pack_of_listing(F.get(packs, (k % 6).cast("int"))).alias("pack"), M.unit_name(unit).alias("unit"))


def styles_gone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names without rules of style sheets, nested ones included."""
    k = F.col("p_partkey")
    spoilt = F.when(k % 2 == 0, F.concat(F.lit(".a{b{c:d}e:f} "), "p_name", F.lit(" #x1{y}"))).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select(k, T.clean_styles(spoilt).alias("name"))


def meals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products by the meal that their tags say."""
    k = F.col("p_partkey")
    tags = F.array(F.get(F.array(*[F.lit(x) for x in ("Sweet", "Dip", "beverage", "quick", "SNACKS")]), (k % 5).cast("int")), F.when(k % 7 == 0, "Breakfast").otherwise("easy"))
    return table(spark, sf_dir, "part").groupBy(M.meal_type(tags).alias("meal")).agg(F.count(F.lit(1)).alias("products"))


def basket_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per list: the retailer that has everything for the least, what that costs, and what it saves against the dearest that has everything."""
    best = whole_chain_baskets(spark, sf_dir)
    return best.select("list_id", "retailer", (F.col("cents") / 100).alias("total"), ((F.col("dearest") - F.col("cents")) / 100).alias("saves"), "complete")


def split_shop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per list: what it costs if every item is bought where the same product is cheapest."""
    rows = items(spark, sf_dir, "receipt_id", "product", "price", "status")
    cheapest = rows.groupBy("product").agg(F.min(N.cents(F.col("price"))).alias("cents"))
    return rows.filter("status = 'DRAFT'").join(cheapest, "product").groupBy("receipt_id").agg((F.sum("cents") / 100).alias("total"), F.count(F.lit(1)).alias("items"))


_TITLE = "list_transform(list_filter(string_split({0}, ' '), lambda w: w <> ''), lambda w, i: CASE WHEN i > 1 AND w IN ('and', 'of', 'or', 'the', 'with') THEN w ELSE upper(w[1]) || w[2:] END)"
_SQUEEZE = "trim(regexp_replace({0}, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))"
_DOTS = "trim(regexp_replace(regexp_replace(replace(replace(lower(x), '''', ''), '&', ' and '), '[^a-z0-9. ]+', ' ', 'g'), ' +', ' ', 'g'))"
_BLOCKS = "p|div|br|li|tr|td|th|h1|h2|h3|h4|h5|h6|ul|ol|table|section|article|header|footer|title"
_ENTITIES = "replace(replace(replace(replace(replace(replace({0}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39)), '&amp;', '&')"
QUERIES = {
    "page_lines": (page_lines, f"""WITH b AS (SELECT page_id, regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?i)</?({_BLOCKS})[^>]*>', chr(10), 'g') AS t FROM pages),
l AS (SELECT page_id, list_filter(list_transform(string_split(t, chr(10)), lambda x: {_SQUEEZE.format(_ENTITIES.format("regexp_replace(x, '<[^>]*>', ' ', 'g')"))}), lambda x: x <> '') AS l FROM b),
u AS (SELECT page_id, x, i FROM (SELECT page_id, unnest(l) AS x, unnest(range(len(l))) AS i FROM l) QUALIFY row_number() OVER (PARTITION BY page_id, x ORDER BY i) = 1), g AS (SELECT page_id, count(*) AS n, string_agg(x, chr(10) ORDER BY i) AS t FROM u GROUP BY page_id)
SELECT page_id, CAST(coalesce(n, 0) AS INT) AS lines, md5(coalesce(t, '')) AS text_md5 FROM pages LEFT JOIN g USING (page_id)"""),
    "line_fingerprints": (line_fingerprints, "SELECT l_orderkey, sha256(string_agg('part ' || l_partkey, chr(10) ORDER BY ' Part ' || l_partkey || ' ')) AS fingerprint FROM lineitem GROUP BY l_orderkey"),
    "name_forms": (name_forms, f"""WITH {GOODS_SQL}, n AS (SELECT id, CASE WHEN id % 3 = 0 THEN concat_ws(' ', brand, 'o''', name, '& co 1.5kg,') ELSE name || ' of the <b>/2kg!' || stored END AS x FROM goods)
SELECT id, array_to_string({_TITLE.format(_DOTS)}, ' ') AS title, {_SQUEEZE.format("regexp_replace(regexp_replace(regexp_replace(x, '(?i)([0-9])(kg|g|mg|ml|l)\\b', '\\1 \\2', 'g'), '[,;:]+', ' ', 'g'), '\\.+( |$)', ' ', 'g')")} AS spaced,
  trim({_SQUEEZE.format("regexp_replace(x, '[^A-Za-z0-9&'' .-]+', ' ', 'g')")}[:30]) AS query, {_DOTS} AS with_dots, trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g')) AS bare, trim(regexp_replace(replace(lower(x), '&', ' and '), '[^a-z0-9.]+', ' ', 'g')) AS spelled FROM n WHERE x IS NOT NULL"""),
    "likeness": (likeness, f"""WITH {GOODS_SQL}, p AS (SELECT a.id, lower(a.name) AS a, lower(b.name) AS b FROM goods a JOIN goods b ON b.id = a.id + 1), s AS (SELECT id, a, b, 1 - levenshtein(a, b) / greatest(length(a), length(b)) AS s FROM p)
SELECT id, floor(CASE WHEN least(length(a), length(b)) >= 4 AND (starts_with(a, b) OR starts_with(b, a)) THEN greatest(s, 0.8) ELSE s END * 1e6 + 0.5) / 1e6 AS letters, floor(len(list_filter(string_split(a, ' '), lambda w: list_contains(string_split(b, ' '), w))) / len(string_split(a, ' ')) * 1e6 + 0.5) / 1e6 AS words FROM s"""),
    "said_amounts": (said_amounts, f"""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN CAST(printf('%.2f', CAST(p_size || '.' || lpad(CAST(p_partkey % 200 * 5 AS VARCHAR), 3, '0') AS DOUBLE)) AS DOUBLE) WHEN 1 THEN NULL ELSE p_size::DOUBLE END AS price, CASE p_partkey % 3 WHEN 0 THEN p_size + 0.5::DOUBLE WHEN 1 THEN 0.5::DOUBLE END AS amount, CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_size * 60 + 15 AS BIGINT) END AS minutes,
  {_LIST(("2000ml", "500g", "1500g", "12pack", "6pack", "750ml"))}[CAST(p_partkey % 6 AS INT) + 1] AS pack, {_LIST(("g", "L", "each", "kg", "bunch"))}[CAST(p_partkey % 5 AS INT) + 1] AS unit FROM part"""),
    "styles_gone": (styles_gone, "SELECT p_partkey, p_name AS name FROM part"),
    "meals": (meals, "SELECT CASE WHEN p_partkey % 7 = 0 THEN 'Breakfast' ELSE ['Desserts', 'Sides & sauces', 'Drinks', 'Lunch & dinner', 'Snacks'][CAST(p_partkey % 5 AS INT) + 1] END AS meal, count(*) AS products FROM part GROUP BY 1"),
    "basket_summary": (basket_summary, f"""WITH bs AS ({CHAINS_SQL}), w AS (SELECT list_id, retailer, CAST(round(total * 100) AS BIGINT) AS cents FROM bs WHERE missing = 0)
SELECT list_id, arg_min(retailer, (cents, retailer)) AS retailer, min(cents) / 100 AS total, (max(cents) - min(cents)) / 100 AS saves, count(*) AS complete FROM w GROUP BY list_id"""),
    "split_shop": (split_shop, "WITH c AS (SELECT p_name, min(CAST(floor((l_extendedprice + 2.220446049250313e-16) * 100 + 0.5) AS BIGINT)) AS cents FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) SELECT l_orderkey AS receipt_id, CAST(sum(cents) AS BIGINT) / 100 AS total, count(*) AS items FROM lineitem JOIN part ON l_partkey = p_partkey JOIN c USING (p_name) JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O' GROUP BY 1"),
}
