"""Recipes against the pantry, lists, jobs and plans as changes of state, health summaries: over the tables' orders, lines and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.functions import numbers as N
from basketry.operators import relational as R
from basketry.plans.fixtures import table

#: The moment as of which jobs and listings are judged.
NOW = "2024-01-20 12:00:00"
_LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with unit and quantity, which is unknown where it is 50."""
    units = F.array(*[F.lit(u) for u in ("kg", "g", "l", "ml", "item", "bunch")])
    return table(spark, sf_dir, "lineitem").select(*_LINE, F.nullif("l_quantity", F.lit(50.0)).alias("quantity"), F.get(units, (F.col("l_linenumber").cast("int") + F.col("l_suppkey").cast("int")) % 6).alias("unit"), "l_returnflag", "l_shipdate")


LINES = "li AS (SELECT *, nullif(l_quantity, 50) AS quantity, ['kg', 'g', 'l', 'ml', 'item', 'bunch'][CAST((l_linenumber + l_suppkey) % 6 AS INT) + 1] AS unit FROM lineitem)"


def _needs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingredients: the lines of open orders, which are recipes here; every third names its product instead of giving its key.  A name
    means the first product that has it."""
    o = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select("o_orderkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    first = part.groupBy("p_name").agg(F.min("p_partkey").alias("first"))
    by_key = part.join(first, "p_name").select(F.col("p_partkey").alias("l_partkey"), "first")
    lines = _lines(spark, sf_dir).join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").join(by_key, "l_partkey")
    return lines.withColumn("product", F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 3 == 0, F.col("first")).otherwise(F.col("l_partkey")))


NEEDS = f"""{LINES}, first AS (SELECT p_partkey AS k, min(p_partkey) OVER (PARTITION BY p_name) AS f FROM part),
needs AS (SELECT li.*, CASE WHEN (l_orderkey + l_linenumber) % 3 = 0 THEN f ELSE l_partkey END AS product FROM li JOIN first ON l_partkey = k WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')),
dims AS (SELECT * FROM (VALUES ('kg', 'mass', 1000.0::DOUBLE), ('g', 'mass', 1.0), ('l', 'volume', 1000.0), ('ml', 'volume', 1.0), ('item', 'count', 1.0)) t(unit, dim, factor)),
pantry AS (SELECT l_partkey AS product, dim, sum(quantity * factor) AS have FROM li LEFT JOIN dims USING (unit) WHERE l_returnflag = 'A' AND quantity > 0 GROUP BY ALL)"""


def _pantry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positive stock per product and dimension, in base units."""
    rows = _lines(spark, sf_dir).filter("l_returnflag = 'A' AND quantity > 0")
    return rows.groupBy(F.col("l_partkey").alias("product"), N.dimension(F.col("unit")).alias("dim")).agg(F.sum(F.col("quantity") * N.factor(F.col("unit"))).alias("have"))


def planner_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per product and dimension (or unit, where it has none or the amount isn't known): what all recipes require, in the unit of the first, and the status."""
    c = F.col
    rows = _needs(spark, sf_dir).withColumns({"dim": F.when(c("quantity").isNotNull(), N.dimension(c("unit"))), "factor": N.factor(c("unit"))})
    order = F.struct(*_LINE)
    need = rows.groupBy("product", F.coalesce("dim", "unit").alias("kind"), "dim").agg(F.sum(c("quantity") * F.coalesce(F.when(c("dim").isNotNull(), c("factor")), F.lit(1.0))).alias("base"), F.min_by(F.struct("unit", "factor"), order).alias("u"))
    pantry = _pantry(spark, sf_dir)
    same = pantry.filter("dim is not null")
    some = pantry.groupBy("product").agg(F.lit(True).alias("stocked"))
    joined = need.join(some, "product", "left").join(same, ["product", "dim"], "left")
    have, base = F.coalesce("have", F.lit(0.0)), c("base")
    status = F.when(c("stocked").isNull(), "missing").when(base.isNull() | c("dim").isNull() | (have == 0) | (have >= base), "in-pantry").otherwise("partial")
    unit_factor = F.when(c("dim").isNotNull(), c("u.factor")).otherwise(1.0)
    return joined.select("product", "kind", c("u.unit").alias("unit"), N.round_half_up(base / unit_factor, 4).alias("required"), status.alias("status"), F.when(status == "partial", N.round_half_up((base - have) / unit_factor, 4)).alias("short"))


def slot_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per recipe: ingredients, those whose product is stocked, and their share in whole per cent."""
    stocked = _pantry(spark, sf_dir).select("product").distinct().withColumn("hit", F.lit(1))
    rows = _needs(spark, sf_dir).join(stocked, "product", "left")
    return rows.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("ingredients"), F.count("hit").alias("available")).withColumn("percent", F.floor(F.col("available") * 100 / F.greatest("ingredients", F.lit(1)) + 0.5).cast("int"))


def list_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingredients put on lists that have some already: same product and unit add up, an unknown amount gives way to a known one, other units leave the old entry."""
    c = F.col
    rows = _lines(spark, sf_dir)
    side = lambda cond: rows.filter(cond).groupBy("l_orderkey", "l_suppkey").agg(F.min_by(F.struct("quantity", "unit"), F.struct(*_LINE)).alias("x")).select("l_orderkey", "l_suppkey", "x.*")
    old, new = side("l_returnflag = 'A'"), side("l_returnflag <> 'A'").withColumnsRenamed({"quantity": "q", "unit": "u"})
    joined = old.join(new, ["l_orderkey", "l_suppkey"], "full_outer")
    both = c("unit").isNotNull() & c("u").isNotNull()
    quantity = F.when(both & (c("u") == c("unit")) & c("q").isNotNull() & c("quantity").isNotNull(), c("quantity") + c("q")).when(both & c("quantity").isNull(), c("q")).otherwise(F.when(c("unit").isNull(), c("q")).otherwise(c("quantity")))
    unit = F.when(both & c("quantity").isNull() & c("q").isNotNull(), c("u")).otherwise(F.coalesce("unit", "u"))
    return joined.select("l_orderkey", "l_suppkey", quantity.alias("quantity"), unit.alias("unit"))


def daily_summary(spark: SparkSession, sf_dir: str, day: str = "2024-01-20") -> DataFrame:
    """Per user, of one day: counted values, minutes (whole, never negative), the latest weight of thirty days, and values since noon of the day before."""
    c, start = F.col, F.lit(day).cast("timestamp")
    end = start + F.expr("INTERVAL 1 DAY")
    today = (c("ts") >= start) & (c("ts") < end)
    of = lambda kind, when: (c("event_type") == kind) & when
    cents = lambda cond: F.coalesce(F.sum(F.when(cond, F.round(c("value") * 100).cast("long"))), F.lit(0)) / 100
    weight = of("purchase", (c("ts") >= end - F.expr("INTERVAL 30 DAYS")) & (c("ts") < end))
    e = table(spark, sf_dir, "events").filter((c("ts") >= end - F.expr("INTERVAL 30 DAYS")) & (c("ts") < end))
    return e.groupBy("user_id").agg(cents(of("click", today)).alias("steps"), F.coalesce(F.sum(F.when(of("view", today), F.floor(F.greatest(c("value") - 100, F.lit(0.0)) / 60))), F.lit(0)).alias("minutes"), F.max_by(F.when(weight, c("value")), F.when(weight, F.struct("ts", "event_id"))).alias("weight"), cents(of("error", c("ts") >= start - F.expr("INTERVAL 12 HOURS"))).alias("sleep"))


def metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily summaries as rows of metric and value, without those that aren't known."""
    wide = daily_summary(spark, sf_dir).select("user_id", "steps", F.col("minutes").cast("double").alias("minutes"), "weight", "sleep")
    return wide.unpivot(["user_id"], ["steps", "minutes", "weight", "sleep"], "metric", "value").filter("value is not null")


def enabled_retailers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per customer: the retailers that are enabled, all of them where none are saved, and those that are missing."""
    every = F.array(F.lit("coles"), F.lit("woolworths"))
    k = F.col("c_custkey")
    saved = F.when(k % 3 == 0, F.array(F.lit("coles"))).when(k % 3 == 1, F.array(F.lit("woolworths"), F.lit("coles")))
    enabled = F.coalesce(saved, every)
    return table(spark, sf_dir, "customer").select(k, F.array_join(F.array_sort(enabled), ",").alias("enabled"), F.array_join(F.array_except(every, enabled), ",").alias("missing"))


def own_sources(spark: SparkSession, sf_dir: str, user: int = 12) -> DataFrame:
    """Events whose composite source begins with one user's."""
    e = table(spark, sf_dir, "events").withColumn("source", F.format_string("user:%d:%s", "user_id", "event_type"))
    return e.filter(F.col("source").startswith(f"user:{user}:")).select("event_id", "source")


def low_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve stock records of least quantity, two at most, then by product."""
    return _lines(spark, sf_dir).filter("l_returnflag = 'A' AND quantity <= 2").orderBy("quantity", "l_partkey", *_LINE).limit(12).select("l_orderkey", "l_linenumber", "l_partkey", "quantity")


def attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four large open orders that have waited longest."""
    return table(spark, sf_dir, "orders").filter("o_orderstatus = 'O' AND o_totalprice > 300000").orderBy("o_orderdate", "o_orderkey").limit(4).select("o_orderkey", "o_orderdate")


def sampled_parts(spark: SparkSession, sf_dir: str, seed: int = 7, n: int = 40) -> DataFrame:
    """A sample that is random but the same for a seed: large parts first, then the others."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").withColumn("m", F.md5(F.concat_ws(":", F.lit(str(seed)), k.cast("string")))).orderBy((F.col("p_size") >= 49).desc(), "m").limit(n).select("p_partkey", "p_size")


def appended_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations (user, type, hour) old and new: a new one is left out if its key was there before."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.date_trunc("hour", "ts").alias("hour"), "event_id")
    return R.insert_absent(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), ["user_id", "event_type", "hour"]).select("event_id")


def job_states(spark: SparkSession, sf_dir: str, lease: str = "15 MINUTES") -> DataFrame:
    """Jobs (user and value of ten) from their events: attempts, state, and when to try again; a claim without a sign of life within the lease is released."""
    c, at = F.col, F.struct("ts", "event_id")
    e = table(spark, sf_dir, "events").filter(c("ts") < F.lit(NOW).cast("timestamp")).withColumn("job", (c("value") / 10).cast("long"))
    step = c("event_type") != "view"
    jobs = e.groupBy("user_id", "job").agg(F.max_by(F.when(step, c("event_type")), F.when(step, at)).alias("last"), F.count_if(c("event_type") == "click").alias("attempts"), F.max("ts").alias("seen"))
    stale = (c("last") == "click") & (c("seen") < F.lit(NOW).cast("timestamp") - F.expr(f"INTERVAL {lease}"))
    state = F.when(stale, "queued").when(c("last") == "click", "running").when(c("last") == "purchase", "done").when(c("last") == "error", "failed").otherwise("queued")
    return jobs.select("user_id", "job", "attempts", state.alias("state"), F.when(state == "failed", N.backoff_seconds(c("attempts"))).alias("retry_after"))


def rolled_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user: the value after all changes that expected the value before them, and the one that a rollback gives: a change with another expectation is refused."""
    c = F.col
    w = R.ordered(["user_id"], [c("ts"), c("event_id")])
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type").withColumn("version", F.row_number().over(w))
    # a change expects the version before it, but for one in seven, which expects an older one
    done = e.filter("event_id % 7 <> 0").withColumns({"prior": F.lag("event_type").over(w)})
    last = R.top_rows(done, ["user_id"], [c("ts").desc(), c("event_id").desc()])
    refused = e.groupBy("user_id").agg(F.count_if(c("event_id") % 7 == 0).alias("refused"))
    return last.join(refused, "user_id").select("user_id", c("event_type").alias("current"), c("prior").alias("rollback"), "refused")


def reclassified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts after a repair: promotions without a size go, small economy parts become small, names lose a colour in front."""
    p = table(spark, sf_dir, "part")
    kept = p.filter(~((F.col("p_type") == "PROMO") & (F.col("p_size") <= 2)))
    return kept.select("p_partkey", F.when((F.col("p_type") == "ECONOMY") & (F.col("p_size") < 10), "SMALL").otherwise(F.col("p_type")).alias("p_type"), F.regexp_replace("p_name", r"^(?:red|blue|green) ", "").alias("p_name"))


def label_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label panels after an import: every measure keeps its old value where the import doesn't know it, lists keep theirs where the import's are empty."""
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part")
    tags = lambda cond, x: F.when(cond, F.array(x)).otherwise(F.array().cast("array<string>"))
    old = p.filter(k % 3 != 0).select(k.alias("id"), F.when(k % 2 == 0, F.col("p_size")).alias("size"), F.col("p_retailprice").alias("energy"), tags(k % 4 != 0, F.col("p_type")).alias("allergens"))
    new = p.filter(k % 5 != 0).select(k.alias("id"), (F.col("p_size") + 100).alias("size"), F.when(k % 7 == 0, F.col("p_retailprice") * 2).alias("energy"), tags(k % 6 == 0, F.col("p_brand")).alias("allergens"))
    return R.upsert(old, new, "id").select("id", "size", "energy", F.array_join("allergens", ",").alias("allergens"))


def planned_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Meal plans (user, day, part of the day): the last choice of each slot; a choice of nothing empties it."""
    c = F.col
    e = table(spark, sf_dir, "events").withColumns({"day": F.to_date("ts"), "slot": (F.hour("ts") / 8).cast("int")})
    last = R.top_rows(e, ["user_id", "day", "slot"], [c("ts").desc(), c("event_id").desc()])
    return last.filter("event_type <> 'error'").select("user_id", "day", "slot", c("event_type").alias("meal"), "event_id")


def stocked_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per product: stock after ticked lines were put in once each (those stocked before don't count again), and whether it must be bought again."""
    c = F.col
    rows = _lines(spark, sf_dir).withColumn("before", c("l_linenumber") % 2 == 0)
    amount = F.coalesce("quantity", F.lit(1.0))
    return rows.groupBy("l_partkey").agg(F.sum(F.when(c("before"), amount).otherwise(0.0)).alias("stock"), F.sum(F.when(~c("before") & (c("l_returnflag") == "A"), amount).otherwise(0.0)).alias("added"), F.sum(F.when(c("l_returnflag") == "R", amount).otherwise(0.0)).alias("used")).select("l_partkey", (c("stock") + c("added") - c("used")).alias("stock"), (c("stock") + c("added") - c("used") <= 0).alias("buy"))


def claimed_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per pairing (user and hour): the claim that won, and how many came too late."""
    e = table(spark, sf_dir, "events").withColumn("hour", F.date_trunc("hour", "ts"))
    return e.groupBy("user_id", "hour").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("winner"), (F.count(F.lit(1)) - 1).alias("late"))


def stale_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user and type: whether the last event is older than that type's time to live, so that it must be refreshed."""
    ttl = F.create_map(*[F.lit(x) for pair in {"click": 6, "view": 6, "purchase": 168}.items() for x in pair])
    last = table(spark, sf_dir, "events").filter(F.col("ts") < F.lit(NOW).cast("timestamp")).groupBy("user_id", "event_type").agg(F.max("ts").alias("seen"))
    hours = (F.unix_seconds(F.lit(NOW).cast("timestamp")) - F.unix_seconds(F.col("seen").cast("timestamp"))) / 3600
    return last.select("user_id", "event_type", F.coalesce(hours > ttl[F.col("event_type")], F.lit(False)).alias("stale"))


def unit_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per part: price for 100 g of a pack in grams, energy in kilojoules, for 100 g and a serving; unknown where a divisor is."""
    k, size, price = F.col("p_partkey"), F.col("p_size").cast("double"), F.col("p_retailprice")
    grams = F.when(k % 5 != 0, size * 25)
    serving = F.when(k % 7 != 0, size)
    kj = N.kilojoules(price / 10)
    return table(spark, sf_dir, "part").select(k, N.round_money(price / grams * 100).alias("per_100"), N.round_half_up(kj, 3).alias("kj"), N.round_half_up(N.per_serving(kj, serving), 3).alias("kj_serving"), N.servings_per_pack(grams, serving).alias("servings"))


def catalogue_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products with their suppliers nested, as one JSON document each: what the document sink writes."""
    line = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("lines"))
    nested = line.groupBy("l_partkey").agg(F.sort_array(F.collect_list(F.struct(F.col("l_suppkey").alias("supplier"), "lines"))).alias("suppliers"))
    p = table(spark, sf_dir, "part").join(nested, F.col("p_partkey") == F.col("l_partkey"), "left")
    return p.select("p_partkey", F.to_json(F.struct(F.col("p_name").alias("name"), F.coalesce("suppliers", F.array().cast("array<struct<supplier:bigint,lines:bigint>>")).alias("suppliers"))).alias("document"))


def write_catalogue(spark: SparkSession, sf_dir: str, path: str) -> None:
    """The document sink: one line of JSON for each product."""
    catalogue_documents(spark, sf_dir).select("document").write.mode("overwrite").text(path)


_ROW = "QUALIFY row_number() OVER (PARTITION BY {0} ORDER BY {1}) = 1"
_DAY = f"""e AS (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-21' - INTERVAL 30 DAY AND ts < TIMESTAMP '2024-01-21'),
d AS (SELECT user_id, coalesce(sum(CAST(round(value * 100) AS BIGINT)) FILTER (event_type = 'click' AND ts >= TIMESTAMP '2024-01-20'), 0) / 100 AS steps, CAST(coalesce(sum(floor(greatest(value - 100, 0) / 60)) FILTER (event_type = 'view' AND ts >= TIMESTAMP '2024-01-20'), 0) AS BIGINT) AS minutes,
  arg_max(value, (ts, event_id)) FILTER (event_type = 'purchase') AS weight, coalesce(sum(CAST(round(value * 100) AS BIGINT)) FILTER (event_type = 'error' AND ts >= TIMESTAMP '2024-01-19 12:00:00'), 0) / 100 AS sleep FROM e GROUP BY user_id)"""

QUERIES = {
    "planner_requirements": (planner_requirements, f"""WITH {NEEDS}, r AS (SELECT n.*, CASE WHEN quantity IS NOT NULL THEN dim END AS d, factor FROM needs n LEFT JOIN dims USING (unit)),
g AS (SELECT product, coalesce(d, unit) AS kind, d, sum(quantity * CASE WHEN d IS NULL THEN 1 ELSE factor END) AS base, arg_min(unit, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS unit FROM r GROUP BY 1, 2, 3),
j AS (SELECT g.*, CASE WHEN d IS NULL THEN 1 ELSE factor END AS f, coalesce(have, 0) AS h, EXISTS (SELECT 1 FROM pantry x WHERE x.product = g.product) AS stocked FROM g LEFT JOIN dims ON g.unit = dims.unit LEFT JOIN pantry p ON p.product = g.product AND p.dim = g.d),
s AS (SELECT *, CASE WHEN NOT stocked THEN 'missing' WHEN base IS NULL OR d IS NULL OR h = 0 OR h >= base THEN 'in-pantry' ELSE 'partial' END AS status FROM j)
SELECT product, kind, unit, floor(base / f * 10000 + 0.5) / 10000 AS required, status, CASE WHEN status = 'partial' THEN floor((base - h) / f * 10000 + 0.5) / 10000 END AS short FROM s"""),
    "slot_percent": (slot_percent, f"WITH {NEEDS} SELECT l_orderkey, count(*) AS ingredients, count(*) FILTER (product IN (SELECT product FROM pantry)) AS available, CAST(floor(count(*) FILTER (product IN (SELECT product FROM pantry)) * 100 / count(*) + 0.5) AS INT) AS percent FROM needs GROUP BY l_orderkey"),
    "list_merges": (list_merges, f"""WITH {LINES}, o AS (SELECT l_orderkey, l_suppkey, quantity, unit FROM li WHERE l_returnflag = 'A' {_ROW.format("l_orderkey, l_suppkey", ", ".join(_LINE))}), n AS (SELECT l_orderkey, l_suppkey, quantity AS q, unit AS u FROM li WHERE l_returnflag <> 'A' {_ROW.format("l_orderkey, l_suppkey", ", ".join(_LINE))})
SELECT l_orderkey, l_suppkey, CASE WHEN unit IS NULL THEN q WHEN u IS NULL OR q IS NULL THEN quantity WHEN quantity IS NULL THEN q WHEN unit = u THEN quantity + q ELSE quantity END AS quantity, CASE WHEN unit IS NULL OR (u IS NOT NULL AND quantity IS NULL AND q IS NOT NULL) THEN u ELSE unit END AS unit FROM o FULL JOIN n USING (l_orderkey, l_suppkey)"""),
    "daily_summary": (daily_summary, f"WITH {_DAY} SELECT * FROM d"),
    "metric_rows": (metric_rows, f"WITH {_DAY}, w AS (SELECT user_id, CAST(steps AS DOUBLE) AS steps, CAST(minutes AS DOUBLE) AS minutes, weight, CAST(sleep AS DOUBLE) AS sleep FROM d) SELECT user_id, 'steps' AS metric, steps AS value FROM w UNION ALL SELECT user_id, 'minutes', minutes FROM w UNION ALL SELECT user_id, 'weight', weight FROM w WHERE weight IS NOT NULL UNION ALL SELECT user_id, 'sleep', sleep FROM w"),
    "enabled_retailers": (enabled_retailers, "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'coles' ELSE 'coles,woolworths' END AS enabled, CASE c_custkey % 3 WHEN 0 THEN 'woolworths' ELSE '' END AS missing FROM customer"),
    "own_sources": (own_sources, "SELECT event_id, 'user:12:' || event_type AS source FROM events WHERE user_id = 12"),
    "low_stock": (low_stock, f"WITH {LINES} SELECT l_orderkey, l_linenumber, l_partkey, quantity FROM li WHERE l_returnflag = 'A' AND quantity <= 2 ORDER BY quantity, l_partkey, l_orderkey, l_linenumber, l_suppkey, l_extendedprice LIMIT 12"),
    "attention": (attention, "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 300000 ORDER BY o_orderdate, o_orderkey LIMIT 4"),
    "sampled_parts": (sampled_parts, "SELECT p_partkey, p_size FROM part ORDER BY p_size >= 49 DESC, md5('7:' || p_partkey) LIMIT 40"),
    "appended_once": (appended_once, "WITH e AS (SELECT *, date_trunc('hour', ts) AS h FROM events), o AS (SELECT * FROM e WHERE event_id % 2 = 0) SELECT event_id FROM o UNION ALL SELECT min(event_id) FROM e WHERE event_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM o WHERE o.user_id = e.user_id AND o.event_type = e.event_type AND o.h = e.h) GROUP BY user_id, event_type, h"),
    "job_states": (job_states, f"""WITH e AS (SELECT *, CAST(trunc(value / 10) AS BIGINT) AS job FROM events WHERE ts < TIMESTAMP '{NOW}'), j AS (SELECT user_id, job, arg_max(event_type, (ts, event_id)) FILTER (event_type <> 'view') AS last, count(*) FILTER (event_type = 'click') AS attempts, max(ts) AS seen FROM e GROUP BY 1, 2),
s AS (SELECT user_id, job, attempts, CASE WHEN last = 'click' AND seen < TIMESTAMP '{NOW}' - INTERVAL 15 MINUTE THEN 'queued' WHEN last = 'click' THEN 'running' WHEN last = 'purchase' THEN 'done' WHEN last = 'error' THEN 'failed' ELSE 'queued' END AS state FROM j)
SELECT *, CASE WHEN state = 'failed' THEN CAST(least(3600, 15 * pow(2, greatest(attempts - 1, 0))) AS BIGINT) END AS retry_after FROM s"""),
    "rolled_back": (rolled_back, f"""WITH d AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prior FROM events WHERE event_id % 7 <> 0), l AS (SELECT * FROM d {_ROW.format("user_id", "ts DESC, event_id DESC")})
SELECT user_id, event_type AS current, prior AS rollback, (SELECT count(*) FROM events e WHERE e.user_id = l.user_id AND event_id % 7 = 0) AS refused FROM l"""),
    "reclassified": (reclassified, "SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' AND p_size < 10 THEN 'SMALL' ELSE p_type END AS p_type, regexp_replace(p_name, '^(?:red|blue|green) ', '') AS p_name FROM part WHERE NOT (p_type = 'PROMO' AND p_size <= 2)"),
    "label_upserts": (label_upserts, """WITH o AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN p_size END AS size, p_retailprice AS energy, CASE WHEN p_partkey % 4 <> 0 THEN p_type ELSE '' END AS a FROM part WHERE p_partkey % 3 <> 0),
n AS (SELECT p_partkey AS id, p_size + 100 AS size, CASE WHEN p_partkey % 7 = 0 THEN p_retailprice * 2 END AS energy, CASE WHEN p_partkey % 6 = 0 THEN p_brand ELSE '' END AS a FROM part WHERE p_partkey % 5 <> 0)
SELECT coalesce(n.id, o.id) AS id, CAST(coalesce(n.size, o.size) AS INT) AS size, coalesce(n.energy, o.energy) AS energy, coalesce(nullif(n.a, ''), o.a) AS allergens FROM o FULL JOIN n ON o.id = n.id"""),
    "planned_slots": (planned_slots, f"WITH e AS (SELECT *, CAST(ts AS DATE) AS day, CAST(trunc(hour(ts) / 8) AS INT) AS slot FROM events), l AS (SELECT * FROM e {_ROW.format('user_id, day, slot', 'ts DESC, event_id DESC')}) SELECT user_id, day, slot, event_type AS meal, event_id FROM l WHERE event_type <> 'error'"),
    "stocked_once": (stocked_once, f"""WITH {LINES}, s AS (SELECT l_partkey, sum(CASE WHEN l_linenumber % 2 = 0 THEN coalesce(quantity, 1) ELSE 0 END) + sum(CASE WHEN l_linenumber % 2 = 1 AND l_returnflag = 'A' THEN coalesce(quantity, 1) ELSE 0 END) - sum(CASE WHEN l_returnflag = 'R' THEN coalesce(quantity, 1) ELSE 0 END) AS stock FROM li GROUP BY l_partkey) SELECT l_partkey, CAST(stock AS DOUBLE) AS stock, stock <= 0 AS buy FROM s"""),
    "claimed_once": (claimed_once, "SELECT user_id, date_trunc('hour', ts) AS hour, arg_min(event_id, (ts, event_id)) AS winner, count(*) - 1 AS late FROM events GROUP BY 1, 2"),
    "stale_users": (stale_users, f"SELECT user_id, event_type, coalesce(epoch(TIMESTAMP '{NOW}' - max(date_trunc('second', ts))) / 3600 > CASE event_type WHEN 'click' THEN 6 WHEN 'view' THEN 6 WHEN 'purchase' THEN 168 END, false) AS stale FROM events WHERE ts < TIMESTAMP '{NOW}' GROUP BY 1, 2"),
    "unit_prices": (unit_prices, """WITH u AS (SELECT p_partkey, p_retailprice AS p, CASE WHEN p_partkey % 5 <> 0 THEN p_size * 25.0::DOUBLE END AS g, CASE WHEN p_partkey % 7 <> 0 THEN p_size::DOUBLE END AS s FROM part)
SELECT p_partkey, floor((p / g * 100 + 2.220446049250313e-16) * 100 + 0.5) / 100 AS per_100, floor(p / 10 * 4.184::DOUBLE * 1000 + 0.5) / 1000 AS kj, floor(p / 10 * 4.184::DOUBLE * s / 100 * 1000 + 0.5) / 1000 AS kj_serving, floor(g / s * 10 + 0.5) / 10 AS servings FROM u"""),
    "catalogue_documents": (catalogue_documents, """WITH l AS (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2), s AS (SELECT l_partkey, string_agg('{"supplier":' || l_suppkey || ',"lines":' || n || '}', ',' ORDER BY l_suppkey) AS x FROM l GROUP BY 1)
SELECT p_partkey, '{"name":"' || p_name || '","suppliers":[' || coalesce(x, '') || ']}' AS document FROM part LEFT JOIN s ON p_partkey = l_partkey"""),
}
