"""Pantry, planner, catalogue quality, entity resolution, merges and health metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.functions import names as M
from basketry.functions import numbers as N
from basketry.functions import text as T
from basketry.functions import vocabulary as V
from basketry.operators import relational as R
from basketry.plans.fixtures import AS_OF, ITEMS, MONEY, items, table


def pantry_consolidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicate stock of a product and unit: one row with the sum, the earliest expiry and the latest purchase."""
    rows = items(spark, sf_dir, "product_id", "unit", "item_id", "quantity", "seen", "shelf_days", "bought", "is_food").filter("is_food").withColumn("expires", F.date_add("seen", F.col("shelf_days")))
    grouped = rows.groupBy("product_id", "unit").agg(F.min("item_id").alias("keeper"), F.sum("quantity").alias("quantity"), F.min("expires").alias("expires"), F.max("bought").alias("bought"), F.count(F.lit(1)).alias("merged"))
    return grouped.filter("merged >= 2")


def expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stock records by expiry status as of a fixed moment."""
    rows = items(spark, sf_dir, "seen", "shelf_days", "is_food").filter("is_food").withColumn("expires", F.date_add("seen", F.col("shelf_days")).cast("timestamp"))
    return rows.groupBy(N.expiry_status(F.col("expires"), AS_OF).alias("status")).agg(F.count(F.lit(1)).alias("records"))


def pantry_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per product name: records, departments, units with their sums, earliest expiry, whether anything has expired."""
    rows = items(spark, sf_dir, "product", "unit", "quantity", "seen", "shelf_days", "is_food").filter("is_food").withColumn("expires", F.date_add("seen", F.col("shelf_days")))
    by_unit = rows.groupBy("product", "unit").agg(F.sum("quantity").alias("q"), F.count(F.lit(1)).alias("n"), F.min("expires").alias("e"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("unit", F.coalesce(F.col("q"), F.lit(0.0)).cast("long").alias("q")))), lambda x: F.concat_ws("=", x["unit"], x["q"])), ";")
    return by_unit.groupBy("product").agg(F.sum("n").alias("records"), listed.alias("quantities"), F.min("e").alias("earliest"), F.bool_or(F.col("e") < F.lit(AS_OF).cast("date")).alias("expired")).withColumn("department", M.department(F.col("product")))


def shopping_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicate items of a list: the sum if every quantity is known, else that of the first; special only if all are."""
    rows = items(spark, sf_dir, "receipt_id", "brand", "unit", "item_id", "quantity", "is_special", "status").filter("status = 'DRAFT'")
    total = F.when(F.count("quantity") == F.count(F.lit(1)), F.sum("quantity")).otherwise(F.min_by("quantity", "item_id"))
    return rows.groupBy("receipt_id", "brand", "unit").agg(F.min("item_id").alias("keeper"), total.alias("quantity"), F.bool_and("is_special").alias("special"), F.count(F.lit(1)).alias("n")).filter("n >= 2")


def requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required per product and dimension in the unit of its first row, stock of it, what is short, and the status."""
    rows = items(spark, sf_dir, "product_id", "unit", "quantity", "item_id", "status", "is_food").withColumns({"dim": N.dimension(F.col("unit")), "base": F.col("quantity") * N.factor(F.col("unit")), "factor": N.factor(F.col("unit"))})
    need = rows.filter("status = 'DRAFT'").groupBy("product_id", "dim").agg(F.sum("base").alias("need"), F.min_by(F.struct("unit", "factor"), "item_id").alias("f"))
    have = rows.filter("status = 'IMPORTED' AND is_food AND quantity > 0").groupBy("product_id", "dim").agg(F.sum("base").alias("have"))
    joined = need.join(have, ["product_id", "dim"], "left").withColumn("have", F.coalesce("have", F.lit(0.0)))
    status = F.when(F.col("have") == 0, "missing").when(F.col("have") >= F.coalesce("need", F.lit(0.0)), "in-pantry").otherwise("partial")
    return joined.select("product_id", "dim", F.col("f.unit").alias("unit"), (F.col("need") / F.col("f.factor")).alias("required"), (F.greatest(F.col("need") - F.col("have"), F.lit(0.0)) / F.col("f.factor")).alias("short"), status.alias("status"))


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products with derived gaps, so that checks have something to find."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k.alias("id"), F.when(k % 29 == 0, F.concat("p_name", F.lit(" .css{x}"))).when(k % 31 == 0, F.concat(F.lit(" "), "p_name")).otherwise(F.col("p_name")).alias("name"), F.when(k % 5 != 0, F.col("p_brand")).alias("brand"), F.when(k % 7 != 0, F.col("p_type")).alias("category"),
        F.when(k % 3 != 0, F.lpad(k.cast("string"), 12, "0")).alias("gtin_body"), F.when(k % 4 != 0, F.when(k % 37 == 0, 600.0).otherwise(F.col("p_size").cast("double"))).alias("servings"), F.when(k % 11 != 0, F.when(k % 41 == 0, -1.0).otherwise(F.col("p_retailprice"))).alias("energy"), (k % 13 == 0).alias("produce"), F.when(k % 8 != 0, F.when(k % 15 == 0, "N/A").otherwise("milk, salt")).alias("ingredients"),
    )


CATALOGUE = """cat AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 29 = 0 THEN p_name || ' .css{x}' WHEN p_partkey % 31 = 0 THEN ' ' || p_name ELSE p_name END AS name, CASE WHEN p_partkey % 5 <> 0 THEN p_brand END AS brand, CASE WHEN p_partkey % 7 <> 0 THEN p_type END AS category,
  CASE WHEN p_partkey % 3 <> 0 THEN lpad(CAST(p_partkey AS VARCHAR), 12, '0') END AS gtin_body, CASE WHEN p_partkey % 4 <> 0 THEN CASE WHEN p_partkey % 37 = 0 THEN 600.0 ELSE CAST(p_size AS DOUBLE) END END AS servings, CASE WHEN p_partkey % 8 <> 0 THEN CASE WHEN p_partkey % 15 = 0 THEN 'N/A' ELSE 'milk, salt' END END AS ingredients,
  CASE WHEN p_partkey % 11 <> 0 THEN CASE WHEN p_partkey % 41 = 0 THEN -1.0 ELSE p_retailprice END END AS energy, p_partkey % 13 = 0 AS produce FROM part)"""
WEIGHTS = {
    "name-invalid": 15, "name-needs-repair": 7, "category-missing": 7, "brand-missing": 7, "barcode-missing": 3, "image-missing": 7, "serving-size-missing": 15, "servings-missing": 7, "servings-invalid": 15, "nutrition-missing": 15,
    "nutrition-invalid": 15, "ingredients-missing": 15, "ingredients-placeholder": 15, "allergens-missing": 7, "retailer-link-missing": 7,
}


def inspected(rows: DataFrame) -> DataFrame:
    """rows with issues, score and state; produce needs neither brand, barcode nor label."""
    c, packed = F.col, ~F.col("produce")
    energy = c("energy")
    found = R.issues(
        ("name-invalid", c("name").rlike("[{};]")), ("name-needs-repair", ~c("name").rlike("[{};]") & (T.squeeze(c("name")) != c("name"))), ("category-missing", c("category").isNull()), ("brand-missing", packed & c("brand").isNull()), ("barcode-missing", packed & c("gtin_body").isNull()),
        ("image-missing", c("id") % 12 == 0), ("serving-size-missing", packed & (c("id") % 10 == 0)), ("servings-missing", packed & c("servings").isNull()), ("servings-invalid", packed & ((c("servings") <= 0) | (c("servings") > 500))), ("nutrition-missing", packed & energy.isNull()), ("nutrition-invalid", packed & (energy < 0)),
        ("ingredients-missing", packed & (F.trim(F.coalesce("ingredients", F.lit(""))) == "")), ("ingredients-placeholder", packed & F.trim("ingredients").rlike("(?i)^(?:n/?a|not available|coming soon|unknown)$")), ("allergens-missing", packed & (c("id") % 6 == 0)), ("retailer-link-missing", c("id") % 4 == 1),
    )
    out = rows.withColumn("issues", found).withColumn("score", R.penalty_score(c("issues"), WEIGHTS))
    severe = F.arrays_overlap("issues", F.array(*[F.lit(k) for k, v in WEIGHTS.items() if v == 15]))
    return out.withColumn("state", F.when(F.array_contains("issues", "name-invalid"), "broken").when(severe, "review").when(F.size("issues") > 0, "incomplete").when(c("id") % 2 == 0, "verified").otherwise("enriched"))


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspected(catalogue(spark, sf_dir)).select("id", F.array_join("issues", ",").alias("issues"), "score", "state")


def quality_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many products have each issue."""
    return inspected(catalogue(spark, sf_dir)).select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count(F.lit(1)).alias("products"))


def quality_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts under conditions and the mean score, in one pass."""
    q = inspected(catalogue(spark, sf_dir))
    return q.agg(F.count(F.lit(1)).alias("products"), F.count_if(F.size("issues") == 0).alias("complete"), F.count_if(F.array_contains("issues", "brand-missing")).alias("without_brand"), F.countDistinct("brand").alias("brands"), N.round_half_up(F.sum("score") / F.count(F.lit(1)), 2).alias("mean_score"))


def weakest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred products with the lowest scores."""
    return inspected(catalogue(spark, sf_dir)).orderBy("score", "id").limit(100).select("id", "score", "state")


def gtins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per product with a number: the number with its check digit, and whether it and a spoilt one are valid."""
    body = catalogue(spark, sf_dir).filter("gtin_body is not null").withColumn("gtin", N.with_check_digit(F.col("gtin_body")))
    spoilt = F.concat(F.col("gtin_body"), ((F.right("gtin", F.lit(1)).cast("int") + 1) % 10).cast("string"))
    return body.select("id", "gtin", N.gtin_valid(F.col("gtin")).alias("valid"), N.gtin_valid(spoilt).alias("spoilt_valid"))


def duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the same text but for case and space: the first of each group and their number."""
    key = F.lower(T.squeeze(F.coalesce("text", F.lit(""))))
    return table(spark, sf_dir, "documents").groupBy(F.sha2(key, 256).alias("k")).agg(F.min("doc_id").alias("keeper"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("keeper", "n")


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every product resolved: against the first of its brand and name, else of its name, with the confidence of the step."""
    rows = catalogue(spark, sf_dir).select("id", F.when(F.col("brand").isNotNull(), F.concat_ws("|", "brand", "name")).alias("by_brand"), F.when(F.col("id") % 9 != 0, F.col("name")).alias("by_name"))
    known = rows.withColumnRenamed("id", "match")
    steps = [("brand", "by_brand", known.select("by_brand", "match")), ("name", "by_name", known.select("by_name", "match"))]
    found = R.cascade(rows, steps, "match")
    return found.select("id", "match", "matched_by", F.when(F.col("matched_by") == "brand", 0.98).when(F.col("matched_by") == "name", 0.95).otherwise(0.5).alias("confidence"))


def event_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest value of each user before mid January, filled forward by what came after; unknown values keep the old."""
    e = table(spark, sf_dir, "events").withColumn("v", F.when(F.col("event_id") % 3 != 0, F.col("event_id")))
    split = F.lit("2024-01-15").cast("timestamp")
    newest = lambda rows: R.top_rows(rows, ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "v", "event_type")
    return R.upsert(newest(e.filter(F.col("ts") < split)), newest(e.filter(F.col("ts") >= split)), "user_id")


def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type, with distinct users at all and on weekends' days."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"), F.countDistinct(F.when(F.dayofweek("ts").isin(1, 7), F.col("user_id"))).alias("weekend_users"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))


def event_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user and day: events of each type, 0 where there is none; event_pivot_all has a column for others besides."""
    return pivoted(table(spark, sf_dir, "events"), EVENT_TYPES)


#: All types of the table.
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def event_pivot_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user and day: events of each type, and in other those of no known type, so that the columns sum to all events."""
    return pivoted(table(spark, sf_dir, "events"), EVENT_TYPES, "other")


def pivoted(events: DataFrame, types: tuple[str, ...], other: str | None = None) -> DataFrame:
    """Per user and day: events of each of the types, 0 where there is none, and of any other or none if a name is given."""
    counts = [F.count_if(F.col("event_type") == t).alias(t) for t in types]
    if other:
        counts.append(F.count_if(~F.coalesce(F.col("event_type").isin(*types), F.lit(False))).alias(other))
    return events.withColumn("day", F.to_date("ts")).groupBy("user_id", "day").agg(*counts, F.max(F.get_json_object("props", "$.k").cast("long")).alias("top_k"))


def latest_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events at the last moment of each user."""
    e = table(spark, sf_dir, "events")
    last = e.groupBy("user_id").agg(F.max("ts").alias("ts"))
    return e.join(last, ["user_id", "ts"]).select("user_id", "event_id", "event_type")


def first_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each user and type, and the first job that each type's queue would hand out, with its back-off."""
    first = R.top_rows(table(spark, sf_dir, "events"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")])
    return first.select("user_id", "event_type", "event_id", N.backoff_seconds(F.col("event_id") % 12).alias("retry_after"))


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product names normalised, as slug and with initial capitals."""
    c = F.col("name")
    return catalogue(spark, sf_dir).select(c).distinct().select("name", T.normalise(c).alias("normalised"), T.slug(c).alias("slug"), F.array_join(T.name_tokens(c), " ").alias("tokens"), M.department(c).alias("department"))


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without markup, and digests of them."""
    body = F.regexp_replace(F.coalesce("html", F.lit("")), "(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.strip_markup(body)).alias("text_md5"), F.sha2(F.coalesce("html", F.lit("")), 256).alias("page_sha256"))


def weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by Monday of their week and part of the day, by Brisbane's clock."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(N.week_start(F.col("ts")).alias("week"), N.greeting(F.col("ts")).alias("part")).agg(F.count(F.lit(1)).alias("n"))


def reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts: the sum of their items against the printed total, and counts of reviewed and of food items."""
    rows = items(spark, sf_dir, "receipt_id", "price", "printed_total", "is_food")
    total = F.sum(N.cents(F.col("price")))
    return rows.groupBy("receipt_id").agg((total / 100).alias("total"), F.max("printed_total").alias("printed"), F.count(F.lit(1)).alias("n"), F.count("is_food").alias("reviewed"), F.count_if("is_food").alias("food")).withColumn("differs", F.abs(F.col("total") - F.col("printed")) > 0.05)




def _department_sql(normal: str) -> str:
    """The department of a normalised name, in SQL."""
    return "CASE " + " ".join(f"WHEN regexp_matches({normal}, '\\b(?:{words})\\b') THEN '{name}'" for name, words in V.DEPARTMENT_RULES) + " ELSE 'Other' END"


def reconciled_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts: items and adjustments (discounts, in whole cents) together against the printed total, and units against the printed number."""
    c = F.col
    line = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(N.cents(c("l_extendedprice"))).alias("items"), F.sum(-F.floor(c("l_extendedprice") * c("l_discount") * 100 + 0.5)).alias("adjustments"), F.sum(F.ceil("l_quantity")).alias("units"))
    o = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("l_orderkey"), N.cents(c("o_totalprice")).alias("printed"), (c("o_orderkey") % 120).alias("printed_units"))
    both = line.join(o, "l_orderkey")
    return both.select("l_orderkey", ((c("items") + c("adjustments")) / 100).alias("total"), (F.abs(c("items") + c("adjustments") - c("printed")) > 5).alias("differs"), "units", (c("units") != c("printed_units")).alias("units_differ"))


QUERIES = {
    "pantry_consolidation": (pantry_consolidation, f"WITH {ITEMS} SELECT product_id, unit, min(item_id) AS keeper, sum(quantity) AS quantity, min(seen + shelf_days) AS expires, max(bought) AS bought, count(*) AS merged FROM items WHERE is_food GROUP BY product_id, unit HAVING count(*) >= 2"),
    "expiry": (expiry, f"""WITH {ITEMS}, e AS (SELECT epoch(CAST(seen + shelf_days AS TIMESTAMP)) + 86399 - epoch(TIMESTAMP '{AS_OF}') AS s FROM items WHERE is_food)
SELECT CASE WHEN s < 0 THEN 'expired' WHEN s <= 259200 THEN 'soon' ELSE 'ok' END AS status, count(*) AS records FROM e GROUP BY 1"""),
    "pantry_groups": (pantry_groups, f"""WITH {ITEMS}, u AS (SELECT product, unit, coalesce(sum(quantity), 0) AS q, count(*) AS n, min(seen + shelf_days) AS e FROM items WHERE is_food GROUP BY 1, 2)
SELECT product, CAST(sum(n) AS BIGINT) AS records, string_agg(unit || '=' || CAST(q AS BIGINT), ';' ORDER BY unit) AS quantities, min(e) AS earliest, bool_or(e < CAST(TIMESTAMP '{AS_OF}' AS DATE)) AS expired, {_department_sql("product")} AS department FROM u GROUP BY product"""),
    "shopping_merge": (shopping_merge, f"""WITH {ITEMS} SELECT receipt_id, brand, unit, min(item_id) AS keeper, CASE WHEN count(quantity) = count(*) THEN sum(quantity) ELSE arg_min_null(quantity, item_id) END AS quantity,
  bool_and(is_special) AS special, count(*) AS n FROM items WHERE status = 'DRAFT' GROUP BY receipt_id, brand, unit HAVING count(*) >= 2"""),
    "requirements": (requirements, f"""WITH {ITEMS}, r AS (SELECT *, CASE WHEN unit IN ('kg', 'g') THEN 'mass' WHEN unit IN ('l', 'ml') THEN 'volume' ELSE 'count' END AS dim, CASE WHEN unit IN ('kg', 'l') THEN 1000.0 ELSE 1.0 END::DOUBLE AS factor FROM items),
n AS (SELECT product_id, dim, sum(quantity * factor) AS need, arg_min(unit, item_id) AS unit, arg_min(factor, item_id) AS factor FROM r WHERE status = 'DRAFT' GROUP BY ALL),
h AS (SELECT product_id, dim, sum(quantity * factor) AS have FROM r WHERE status = 'IMPORTED' AND is_food AND quantity > 0 GROUP BY ALL)
SELECT product_id, dim, unit, need / factor AS required, CASE WHEN need IS NULL THEN 0.0 ELSE greatest(need - coalesce(have, 0), 0) END / factor AS short,
  CASE WHEN coalesce(have, 0) = 0 THEN 'missing' WHEN have >= coalesce(need, 0) THEN 'in-pantry' ELSE 'partial' END AS status FROM n LEFT JOIN h USING (product_id, dim)"""),
    "gtins": (gtins, f"""WITH {CATALOGUE}, d AS (SELECT id, gtin_body, CAST((10 - (SELECT sum(CAST(gtin_body[13 - i] AS INT) * CASE WHEN i % 2 = 1 THEN 3 ELSE 1 END) FROM range(1, 13) t(i)) % 10) % 10 AS VARCHAR) AS digit FROM cat WHERE gtin_body IS NOT NULL)
SELECT id, gtin_body || digit AS gtin, true AS valid, false AS spoilt_valid FROM d"""),
    "duplicates": (duplicates, r"SELECT keeper, n FROM (SELECT sha256(lower(trim(regexp_replace(coalesce(text, ''), '[ \t\n\r\f\x0B]+', ' ', 'g')))) AS k, min(doc_id) AS keeper, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1)"),
    "resolved": (resolved, f"""WITH {CATALOGUE}, r AS (SELECT id, brand, name, CASE WHEN brand IS NOT NULL THEN min(id) OVER (PARTITION BY brand, name) END AS b, id % 9 <> 0 AS named FROM cat), n AS (SELECT name, min(id) AS n FROM cat WHERE id % 9 <> 0 GROUP BY name)
SELECT id, coalesce(b, CASE WHEN named THEN n END) AS match, CASE WHEN b IS NOT NULL THEN 'brand' WHEN named THEN 'name' ELSE 'create' END AS matched_by, CAST(CASE WHEN b IS NOT NULL THEN 0.98 WHEN named THEN 0.95 ELSE 0.5 END AS DOUBLE) AS confidence FROM r LEFT JOIN n USING (name)"""),
    "event_upsert": (event_upsert, """WITH e AS (SELECT *, CASE WHEN event_id % 3 <> 0 THEN event_id END AS v FROM events),
o AS (SELECT user_id, v, event_type FROM e WHERE ts < TIMESTAMP '2024-01-15' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
n AS (SELECT user_id, v, event_type FROM e WHERE ts >= TIMESTAMP '2024-01-15' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT coalesce(n.user_id, o.user_id) AS user_id, coalesce(n.v, o.v) AS v, coalesce(n.event_type, o.event_type) AS event_type FROM o FULL JOIN n ON o.user_id = n.user_id"""),
    "event_counts": (event_counts, "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, count(DISTINCT user_id) FILTER (dayofweek(ts) IN (0, 6)) AS weekend_users, min(event_id) AS first_event, max(event_id) AS last_event FROM events GROUP BY event_type"),
    "event_pivot": (event_pivot, "SELECT user_id, CAST(ts AS DATE) AS day, " + ", ".join(f"count(*) FILTER (event_type = '{t}') AS {t}" for t in EVENT_TYPES) + ", max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS top_k FROM events GROUP BY 1, 2"),
    "event_pivot_all": (event_pivot_all, "SELECT user_id, CAST(ts AS DATE) AS day, " + ", ".join(f"count(*) FILTER (event_type = '{t}') AS {t}" for t in EVENT_TYPES) + f", count(*) FILTER (event_type IS NULL OR event_type NOT IN {EVENT_TYPES}) AS other, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS top_k FROM events GROUP BY 1, 2"),
    "latest_metrics": (latest_metrics, "SELECT user_id, event_id, event_type FROM events JOIN (SELECT user_id, max(ts) AS ts FROM events GROUP BY user_id) USING (user_id, ts)"),
    "first_events": (first_events, "SELECT user_id, event_type, event_id, CAST(least(3600, 15 * pow(2, greatest(event_id % 12 - 1, 0))) AS BIGINT) AS retry_after FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1"),
    "names": (names, f"""WITH {CATALOGUE}, n AS (SELECT DISTINCT name, trim(regexp_replace(lower(name), '[^a-z0-9. ]+', ' ', 'g')) AS normalised, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS plain FROM cat)
SELECT name, normalised, replace(normalised, ' ', '-') AS slug, array_to_string(list_transform(list_filter(string_split(plain, ' '), lambda w: length(w) > 1), lambda w: CASE WHEN length(w) > 3 AND w LIKE '%s' THEN w[:-2] ELSE w END), ' ') AS tokens, {_department_sql("normalised")} AS department FROM n"""),
    "page_texts": (page_texts, r"""WITH b AS (SELECT page_id, html, regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g') AS t FROM pages),
e AS (SELECT page_id, html, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&') AS t FROM b)
SELECT page_id, md5(trim(regexp_replace(t, '[ \t\n\r\f\x0B]+', ' ', 'g'))) AS text_md5, sha256(coalesce(html, '')) AS page_sha256 FROM e"""),
    "weeks": (weeks, """SELECT CAST(date_trunc('week', t) AS DATE) AS week, CASE WHEN hour(t) < 12 THEN 'morning' WHEN hour(t) < 17 THEN 'afternoon' ELSE 'evening' END AS part, count(*) AS n FROM (SELECT ts + INTERVAL 10 HOUR AS t FROM events) GROUP BY 1, 2"""),
    "reconciled_units": (reconciled_units, f"""WITH l AS (SELECT l_orderkey, sum(CAST({MONEY.format("l_extendedprice")} AS BIGINT)) - sum(CAST(floor(l_extendedprice * l_discount * 100 + 0.5) AS BIGINT)) AS cents, CAST(sum(ceil(l_quantity)) AS BIGINT) AS units FROM lineitem GROUP BY 1)
SELECT l_orderkey, CAST(cents AS BIGINT) / 100 AS total, abs(cents - {MONEY.format("o_totalprice")}) > 5 AS differs, units, units <> o_orderkey % 120 AS units_differ FROM l JOIN orders ON l_orderkey = o_orderkey"""),
    "reconciled": (reconciled, f"""WITH {ITEMS}, r AS (SELECT receipt_id, CAST(sum(floor((price + 2.220446049250313e-16) * 100 + 0.5)) AS BIGINT) / 100 AS total, max(printed_total) AS printed, count(*) AS n, count(is_food) AS reviewed, count(*) FILTER (is_food) AS food FROM items GROUP BY receipt_id)
SELECT *, abs(total - printed) > 0.05 AS differs FROM r"""),
}

_RULES = {
    "name-invalid": "name LIKE '%{%'", "name-needs-repair": "name NOT LIKE '%{%' AND trim(name) <> name", "category-missing": "category IS NULL", "brand-missing": "NOT produce AND brand IS NULL", "barcode-missing": "NOT produce AND gtin_body IS NULL",
    "image-missing": "id % 12 = 0", "serving-size-missing": "NOT produce AND id % 10 = 0", "servings-missing": "NOT produce AND servings IS NULL", "servings-invalid": "NOT produce AND (servings <= 0 OR servings > 500)", "nutrition-missing": "NOT produce AND energy IS NULL", "nutrition-invalid": "NOT produce AND energy < 0",
    "ingredients-missing": "NOT produce AND ingredients IS NULL", "ingredients-placeholder": "NOT produce AND ingredients = 'N/A'", "allergens-missing": "NOT produce AND id % 6 = 0", "retailer-link-missing": "id % 4 = 1",
}
_SEVERE = [k for k, v in WEIGHTS.items() if v == 15]
_ISSUES = f"""{CATALOGUE}, iss AS (SELECT id, brand, list_filter([{", ".join(f"CASE WHEN {rule} THEN '{name}' END" for name, rule in _RULES.items())}], lambda x: x IS NOT NULL) AS issues FROM cat),
q AS (SELECT *, CAST(greatest(0, 100 - coalesce(list_sum(list_transform(issues, lambda x: CASE WHEN x IN {tuple(_SEVERE)} THEN 15 WHEN x = 'barcode-missing' THEN 3 ELSE 7 END)), 0)) AS INT) AS score,
  CASE WHEN list_contains(issues, 'name-invalid') THEN 'broken' WHEN list_has_any(issues, {_SEVERE}) THEN 'review' WHEN len(issues) > 0 THEN 'incomplete' WHEN id % 2 = 0 THEN 'verified' ELSE 'enriched' END AS state FROM iss)"""
QUERIES |= {
    "quality": (quality, f"WITH {_ISSUES} SELECT id, array_to_string(issues, ',') AS issues, score, state FROM q"),
    "quality_issues": (quality_issues, f"WITH {_ISSUES} SELECT issue, count(*) AS products FROM (SELECT unnest(issues) AS issue FROM q) GROUP BY issue"),
    "quality_health": (quality_health, f"WITH {_ISSUES} SELECT count(*) AS products, count(*) FILTER (len(issues) = 0) AS complete, count(*) FILTER (list_contains(issues, 'brand-missing')) AS without_brand, count(DISTINCT brand) AS brands, floor(sum(score) / count(*) * 100 + 0.5) / 100 AS mean_score FROM q"),
    "weakest": (weakest, f"WITH {_ISSUES} SELECT id, score, state FROM q ORDER BY score, id LIMIT 100"),
}
