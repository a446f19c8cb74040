"""Lines of receipts and labels, made from the tables' values and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.functions import labels as L
from basketry.functions import names as M
from basketry.functions import receipts as P
from basketry.functions import vocabulary as V
from basketry.operators import relational as R
from basketry.operators.durable import cut
from basketry.plans.fixtures import spread, table
from basketry.plans.grocery import GOODS_SQL, goods


def receipt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of three, two and one field, read: description, quantity and price."""
    k, name, price = F.col("p_partkey"), F.col("p_name"), F.format_string("%d.50", "p_size")
    line = F.when(k % 4 == 0, F.concat(F.lit("- "), name, F.lit(" | "), (k % 5).cast("string"), F.lit(" | $"), price)).when(k % 4 == 1, F.concat(name, F.lit("|"), price)).when(k % 4 == 2, F.concat(name, F.lit("   $"), price)).otherwise(name)
    return table(spark, sf_dir, "part").select(k, P.split_line(line).alias("x")).select("p_partkey", "x.*")


FORMS = ("TOTAL {0}.00", "{0} ITEMS", "VISA {0}.00", "GST INCLUDED IN TOTAL {0}.10", "SAVE -{0}.00", "COLES", "12/03/2024 10:15", "APPROVED", "{0} @ 2.50", "MILK {0}.20", "THANK YOU")
FORM_ROLES = ("total", "item-count", "tender", "tax", "promotion", "header", "header", "footer", "quantity", "product", "unknown")


def line_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines of each form have which role."""
    forms = F.array(*[F.lit(f) for f in FORMS])
    form = F.get(forms, (F.col("p_partkey") % len(FORMS)).cast("int"))
    line = F.replace(form, F.lit("{0}"), F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").groupBy(form.alias("form"), P.line_role(line).alias("role")).agg(F.count(F.lit(1)).alias("lines"))


def receipt_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts as text, and the day and the total found in them: other days and totals are there too."""
    o = table(spark, sf_dir, "orders")
    day = F.date_format(F.add_months("o_orderdate", 120), "d/M/yyyy")
    total = F.format_string("%d.25", F.floor("o_totalprice"))
    text = F.concat_ws("\n", F.lit("Shop 1/2/03"), F.concat(F.lit("Date: "), day, F.lit(" 10:00")), F.lit("Total savings 1.00"), F.lit("Milk 3.00"), F.concat(F.lit("TOTAL  $"), total), F.lit("VISA 9.99"))
    return o.select("o_orderkey", P.likely_date(text).alias("day"), P.printed_total(text).alias("total"))


def label_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as lines, and the servings, energy, sodium and allergens found in them."""
    k, n = F.col("p_partkey"), F.col("p_size")
    lines = F.array(F.lit("Nutrition Information"), F.concat(F.lit("Servings per package: "), n.cast("string")), F.concat(F.lit("Serving size: "), n.cast("string"), F.when(k % 2 == 0, " g").otherwise(" L")), F.lit("Energy"), F.concat(n.cast("string"), F.lit(" kJ")), F.concat((n * 10).cast("string"), F.lit(" kJ")), F.lit("Sodium"), F.lit("Per 100 g"), F.concat((n + 5).cast("string"), F.lit(" mg")), F.when(k % 3 == 0, "Contains: Milk, Soy and Wheat.").otherwise("Contains: n/a"))
    df = L.with_label(spread(table(spark, sf_dir, "part").select(k, n)).select(k, lines.alias("lines")), "lines")
    c = F.col
    return df.select("p_partkey", c("label.serving.quantity").alias("serving"), c("label.serving.unit").alias("unit"), c("label.serving.per_package").alias("servings"), c("label.nutrients.energy.per_serving").alias("energy"), c("label.nutrients.energy.per_100").alias("energy_100"), c("label.nutrients.sodium.per_100").alias("sodium"), F.array_join("label.contains", ",").alias("contains"))


def plausible_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products whose spoilt name can still be a name, and whose text reads like ingredients."""
    c, k = F.col, F.col("id")
    spoilt = F.when(k % 5 == 0, F.concat("name", F.lit(" {color:red}"))).when(k % 5 == 1, F.concat("name", F.lit(" font style font weight"))).when(k % 5 == 2, F.lit("x")).otherwise(c("name"))
    text = F.when(k % 4 == 0, F.concat(F.lit("Ingredients: "), "ingredients")).when(k % 4 == 1, F.lit("12 34 56 78, sugar")).when(k % 4 == 2, F.lit("Sugar, salt. Save $1.00 today only")).otherwise(F.lit("water"))
    return goods(spark, sf_dir).select("id", M.plausible(spoilt).alias("name_ok"), L.plausible_ingredients(text).isNotNull().alias("text_ok"))


def longest_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per product, the longest known phrase that its listed name has as whole words."""
    phrases = spark.createDataFrame([(alias, i) for i, alias in enumerate(a for _, _, aliases in V.CONCEPTS for a in aliases)], "phrase string, rank int").groupBy("phrase").agg(F.min("rank").alias("rank"))
    rows = goods(spark, sf_dir, spread).select("id", F.lower(F.concat_ws(" ", "brand", "name", "pack")).alias("text"))
    return R.contained_phrases(rows, "id", "text", phrases)


def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per product name: the product, family, form and identity that it means."""
    names = goods(spark, sf_dir).select("name").distinct()
    df = M.food_identity(M.parsed(M.identified(names, "name"), "name"), "name")
    return df.select("name", F.col("identity.canonical").alias("canonical"), F.col("identity.family").alias("family"), F.col("identity.confidence").alias("confidence"), F.col("parsed.key").alias("key"), F.col("parsed.form").alias("form"), M.grocery_identity(F.col("food")).alias("food"))


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue of names of three words: what documents begin with; id and pack of the first of each name."""
    # up to the third word, as a name needs no word behind it; a text of fewer has none
    begins = F.regexp_extract("text", "(?s)^(?>.*?[A-Za-z]{4,12}){3}", 0)
    w = F.slice(F.regexp_extract_all(begins, F.lit("[A-Za-z]{4,12}"), F.lit(0)), 1, 3)
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars", w.alias("w")).filter("size(w) = 3")
    return rows.groupBy("w").agg(F.min("doc_id").alias("id"), F.concat(F.min("n_chars").cast("string"), F.lit("g")).alias("pack")).withColumn("name", F.array_join("w", " "))


def recognised_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as a scanner reads them, with a letter lost and the pack behind or without it, against the catalogue of all names."""
    titles = cut(_titles(spark, sf_dir))
    first = F.get("w", F.lit(0))
    lost = F.concat(F.substring(first, 1, 1), F.substring(first, 3, 20))
    read = F.upper(F.concat_ws(" ", lost, F.array_join(F.slice("w", 2, 2), " "), "pack"))
    lines = titles.select(F.explode(F.array(read, F.upper("name"))).alias("line"))
    return P.matched_lines(lines, titles.select("id", "name", "pack")).select("line", "id", "name", F.round("confidence", 6).alias("confidence"))


_ALIKE = "CASE WHEN a = b THEN 1.0 WHEN least(length(a), length(b)) >= 4 AND (starts_with(a, b) OR starts_with(b, a)) THEN 0.8 ELSE 1 - levenshtein(a, b) / greatest(length(a), length(b)) END"
_TOKENS = "list_filter(string_split(lower({0}), ' '), lambda t: length(t) > 1 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in P.NOISE) + "], t) AND NOT regexp_matches(t, '^[0-9]'))"
RECOGNISED_SQL = f"""
WITH t AS (SELECT w, min(doc_id) AS id, min(n_chars) || 'g' AS pack, array_to_string(w, ' ') AS name FROM (SELECT doc_id, n_chars, regexp_extract_all(text, '[A-Za-z]{{4,12}}')[1:3] AS w FROM documents) WHERE len(w) = 3 GROUP BY w),
l AS (SELECT DISTINCT line, CASE WHEN regexp_matches(line, '[0-9]+G$') THEN lower(regexp_extract(line, '[0-9]+G$')) END AS p FROM (
  SELECT upper(left(w[1], 1) || substr(w[1], 3) || ' ' || w[2] || ' ' || w[3] || ' ' || pack) AS line FROM t UNION ALL SELECT upper(name) FROM t)),
o AS (SELECT line, p, list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || w[i + 1])) AS x FROM (SELECT *, {_TOKENS.format("line")} AS w FROM l)),
c AS (SELECT id, name, pack, {_TOKENS.format("name")} AS v, lower(name) || '|' || pack AS identity FROM t),
pairs AS (SELECT line, p, id, name, pack, identity, list_transform(v, lambda b: list_max(list_transform(x, lambda a: {_ALIKE}))) AS s FROM o, c WHERE len(x) > 0 AND len(v) > 0),
parts AS (SELECT *, list_filter(s, lambda y: y >= 0.72) AS strong, len(list_filter(s, lambda y: y = 1)) AS exact, list_reverse_sort(s)[1:3] AS top FROM pairs WHERE len(s) < 2 OR list_min(s[2:]) >= 0.72),
scored AS (SELECT line, id, name || ' ' || pack AS name, identity, len(strong) AS n,
  greatest(coalesce(list_sum(strong), 0) / len(s) + exact * 0.035, list_sum(top) / len(top) * 0.72 + least(len(strong), 3) * 0.08 + exact * 0.02)
  + CASE WHEN p IS NULL THEN 0 WHEN p = pack THEN 0.16 WHEN levenshtein(p, pack) = 1 AND abs(length(p) - length(pack)) <= 1 THEN 0.04 ELSE -0.65 END AS score FROM parts),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY line ORDER BY score DESC, id) = 1)
SELECT line, id, name, round(least(1.0, score), 6) AS confidence FROM best b
WHERE n >= 2 AND score >= 0.76 AND NOT EXISTS (SELECT 1 FROM scored s WHERE s.line = b.line AND s.identity <> b.identity AND b.score - s.score < 0.1)"""


def stored_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user: events that are stored as observations: another type than the last stored one, or six hours later."""
    return R.stored_observations(table(spark, sf_dir, "events").select("user_id", "ts", "event_type"), "user_id", "ts", ["event_type"])


_K = "p_partkey"
QUERIES = {
    "receipt_lines": (receipt_lines, "SELECT p_partkey, p_name AS description, CASE WHEN p_partkey % 4 = 0 AND p_partkey % 5 > 0 THEN CAST(p_partkey % 5 AS DOUBLE) ELSE 1.0 END AS quantity, CASE WHEN p_partkey % 4 < 3 THEN p_size + 0.5::DOUBLE END AS price FROM part"),
    "line_roles": (line_roles, f"WITH r AS (SELECT CAST(p_partkey % {len(FORMS)} AS INT) + 1 AS i FROM part) SELECT {list(FORMS)}[i] AS form, {list(FORM_ROLES)}[i] AS role, count(*) AS lines FROM r GROUP BY i"),
    "receipt_heads": (receipt_heads, "SELECT o_orderkey, CAST(o_orderdate + INTERVAL 10 YEAR AS DATE) AS day, floor(o_totalprice) + 0.25::DOUBLE AS total FROM orders"),
    "label_values": (label_values, "SELECT p_partkey, p_size * CASE WHEN p_partkey % 2 = 0 THEN 1.0::DOUBLE ELSE 1000 END AS serving, CASE WHEN p_partkey % 2 = 0 THEN 'g' ELSE 'mL' END AS unit, p_size::DOUBLE AS servings, p_size::DOUBLE AS energy, p_size * 10.0::DOUBLE AS energy_100, p_size + 5.0::DOUBLE AS sodium, CASE WHEN p_partkey % 3 = 0 THEN 'Milk,Soy,Wheat' ELSE '' END AS contains FROM part"),
    "plausible_texts": (plausible_texts, f"WITH {GOODS_SQL} SELECT id, id % 5 >= 3 AS name_ok, id % 4 = 0 AND coalesce(ingredients, '') LIKE 'milk%' AS text_ok FROM goods"),
    "longest_concepts": (longest_concepts, f"""WITH {GOODS_SQL}, p AS (SELECT unnest({[a for _, _, aliases in V.CONCEPTS for a in aliases]}) AS phrase), q AS (SELECT phrase, min(rowid) AS rank FROM (SELECT phrase, row_number() OVER () AS rowid FROM p) GROUP BY phrase)
SELECT id, phrase FROM goods JOIN q ON contains(' ' || lower(concat_ws(' ', brand, name, pack)) || ' ', ' ' || phrase || ' ') QUALIFY row_number() OVER (PARTITION BY id ORDER BY length(phrase) DESC, rank) = 1"""),
    "identities": (identities, None),
    "recognised_products": (recognised_products, RECOGNISED_SQL),
    "stored_prices": (stored_prices, """WITH RECURSIVE e AS (SELECT user_id, ts, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type) AS i FROM events),
r AS (SELECT user_id, i, ts, event_type, true AS stored, s AS last, event_type AS kind FROM e WHERE i = 1 UNION ALL
  SELECT user_id, i, ts, event_type, stored, CASE WHEN stored THEN s ELSE last END, CASE WHEN stored THEN event_type ELSE kind END FROM (SELECT e.*, r.last, r.kind, e.event_type <> r.kind OR e.s - r.last >= 21600 AS stored FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1))
SELECT user_id, ts, event_type FROM r WHERE stored"""),
}
