"""Lookups, choices among records, sets and state changes over the tables, each as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.operators import relational as R
from basketry.plans.fixtures import table

#: The moment that splits events into old and new ones.
SPLIT = "2024-01-15"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with two values that are unknown for some, and whether they are new."""
    k = F.col("event_id")
    e = table(spark, sf_dir, "events")
    return e.withColumns({"a": F.when(k % 3 != 0, k), "b": F.when(k % 5 == 0, F.col("event_type")), "fresh": F.col("ts") >= F.lit(SPLIT).cast("timestamp")})


E = f"e AS (SELECT *, CASE WHEN event_id % 3 <> 0 THEN event_id END AS a, CASE WHEN event_id % 5 = 0 THEN event_type END AS b, ts >= TIMESTAMP '{SPLIT}' AS fresh FROM events)"


def _newest() -> list[Column]:
    return [F.col("ts").desc(), F.col("event_id").desc()]


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements of two kinds since the split, one column each, per user and moment."""
    rows = _events(spark, sf_dir).filter(F.col("fresh") & F.col("event_type").isin("click", "view"))
    return rows.groupBy("ts", "user_id").pivot("event_type", ["click", "view"]).agg(F.max("value"))


def customer_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer with the number, first and last of its open orders: aggregated before the join, 0 where there is none."""
    o = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_order"), F.max("o_orderkey").alias("last_order"))
    c = table(spark, sf_dir, "customer").select("c_custkey")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("open_orders"), "first_order", "last_order")


def largest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that equal the largest of their customer."""
    o = table(spark, sf_dir, "orders")
    most = o.groupBy("o_custkey").agg(F.max("o_totalprice").alias("most"))
    return o.join(most, "o_custkey").filter("o_totalprice = most").select("o_orderkey", "o_custkey")


def overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of counts of separate tables."""
    one = lambda name, cond, out: table(spark, sf_dir, name).agg(F.count_if(F.expr(cond)).alias(out))
    parts = [one("orders", "o_orderstatus = 'O'", "open_orders"), one("customer", "c_acctbal < 0", "in_debt"), one("part", "p_size > 45", "large_parts"), one("events", "event_type = 'error'", "errors")]
    tagged = [p.select(F.lit(p.columns[0]).alias("k"), F.col(p.columns[0]).alias("v")) for p in parts]
    rows = tagged[0].unionAll(tagged[1]).unionAll(tagged[2]).unionAll(tagged[3])
    return rows.agg(*[F.max(F.when(F.col("k") == p.columns[0], F.col("v"))).alias(p.columns[0]) for p in parts])


def families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product names and the longest known family that each ends with: an equality join on all endings of a name."""
    part = table(spark, sf_dir, "part")
    word = F.split("p_name", " ")
    known = part.filter("p_partkey % 7 = 0").select(F.element_at(word, -1).alias("family")).union(part.filter("p_partkey % 50 = 0").select(F.col("p_name").alias("family"))).distinct()
    names = part.select("p_name").distinct().withColumn("w", word)
    ends = names.select("p_name", F.explode(F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.array_join(F.slice("w", i, F.size("w")), " "))).alias("family"))
    return ends.join(known, "family").groupBy("p_name").agg(F.max_by("family", F.length("family")).alias("family"))


def panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products with the measures of their panel where it has one, else their own; the panel's list unless it is empty."""
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(k, F.when(k % 3 != 0, F.col("p_size")).alias("own"), F.array(F.lit("own")).alias("own_tags"))
    panel = table(spark, sf_dir, "part").filter(k % 2 == 0).select(k, F.when(k % 5 != 0, F.col("p_size") + 100).alias("panel"), F.when(k % 4 == 0, F.array("p_type")).otherwise(F.array().cast("array<string>")).alias("tags"))
    joined = p.join(panel, "p_partkey", "left")
    return joined.select("p_partkey", F.coalesce("panel", "own").alias("size"), F.when(F.size(F.coalesce("tags", F.array())) > 0, F.col("tags")).otherwise(F.col("own_tags"))[0].alias("tag"))


def first_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user and column, the newest value that is known."""
    at = F.struct("ts", "event_id")
    return _events(spark, sf_dir).groupBy("user_id").agg(F.max_by("a", F.when(F.col("a").isNotNull(), at)).alias("a"), F.max_by("b", F.when(F.col("b").isNotNull(), at)).alias("b"))


def best_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each user and type the last record; of these each user's most complete, the earliest of equals."""
    last = R.top_rows(_events(spark, sf_dir), ["user_id", "event_type"], _newest())
    score = F.col("a").isNotNull().cast("int") * 2 + F.col("b").isNotNull().cast("int")
    return R.top_rows(last.withColumn("score", score), ["user_id"], [F.col("score").desc(), F.col("event_id")]).select("user_id", "event_type", "event_id", "score")


def voted_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user, the day with most evidence: by number, then highest value, then the later day."""
    votes = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("votes"), F.max("value").alias("top"))
    return R.top_rows(votes, ["user_id"], [F.col("votes").desc(), F.col("top").desc(), F.col("day").desc()])


def priority_queue(spark: SparkSession, sf_dir: str, take: int = 800) -> DataFrame:
    """Open orders by urgency, with unknown priorities last but low, then the oldest; at most 500 whatever is asked."""
    p = F.substring("o_orderpriority", 1, 1).cast("int")
    rank = F.when(p == 1, 0).when(p == 2, 1).otherwise(F.coalesce(F.when(p != 4, p), F.lit(9)))
    o = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").withColumn("urgency", rank)
    return o.orderBy("urgency", "o_orderdate", "o_orderkey").limit(min(max(take, 1), 500)).select("o_orderkey", "urgency")


def ranked_search(spark: SparkSession, sf_dir: str, term: str = "12") -> DataFrame:
    """Customers found by a term: key, region and name that are it, name that begins with it, name that holds it, segment that holds it; a hundred."""
    key, name = F.col("c_custkey").cast("string"), F.regexp_replace(F.lower("c_name"), "^customer#0*", "")
    rank = F.when(key == term, 0).when(F.col("c_nationkey").cast("string") == term, 1).when(name == term, 2).when(name.startswith(term), 3).when(name.contains(term), 4).when(F.lower("c_mktsegment").contains(term), 5)
    return table(spark, sf_dir, "customer").withColumn("rank", rank).filter("rank is not null").orderBy("rank", "c_custkey").limit(100).select("c_custkey", "rank")


def next_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per queue (type of event): the job to hand out next, by priority, then the oldest."""
    e = table(spark, sf_dir, "events").withColumn("priority", (F.col("value") % 7).cast("int"))
    return R.top_rows(e, ["event_type"], [F.col("priority"), F.col("ts"), F.col("event_id")]).select("event_type", "event_id", "priority")


def piped_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files (by brand and size) of lines of six fields: name, price, pack, unit price, brand, special; a file with any error is refused as a whole."""
    k, c = F.col("p_partkey"), F.col
    line = F.concat_ws("|", F.when(k % 211 != 0, c("p_name")).otherwise(" "), F.when(k % 97 != 0, k.cast("string")).otherwise("-1"), F.concat(c("p_size").cast("string"), F.lit(" g")), F.lit("1.5"), c("p_brand"), F.when(k % 3 == 0, "special").otherwise(""))
    f = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", F.split(line, "[|]", -1).alias("f"))
    at = lambda i: F.trim(F.get("f", F.lit(i)))
    price = at(1).try_cast("double")
    error = F.when(F.size("f") != 6, "fields").when(at(0) == "", "name").when(price.isNull() | (price <= 0), "price")
    read = f.select("p_brand", "p_size", at(0).alias("name"), price.alias("price"), (at(5) == "special").alias("special"), error.alias("error"))
    return read.groupBy("p_brand", "p_size").agg(F.count(F.lit(1)).alias("lines"), F.count("error").alias("errors"), F.count_if("special").alias("specials"), F.sum("price").alias("total")).withColumn("accepted", F.when(F.col("errors") == 0, F.col("lines")).otherwise(0))


def unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of three sources whose link is unknown, with the source's name."""
    e = _events(spark, sf_dir)
    p, c = table(spark, sf_dir, "part"), table(spark, sf_dir, "customer")
    rows = e.filter("a is null").select(F.lit("event").alias("source"), F.col("event_id").alias("id"))
    return rows.unionByName(p.filter("p_partkey % 5 = 0").select(F.lit("part").alias("source"), F.col("p_partkey").alias("id"))).unionByName(c.filter("c_acctbal < 0").select(F.lit("customer").alias("source"), F.col("c_custkey").alias("id")))


def active_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users that bought, or had an error since the split: distinct ids of either."""
    e = _events(spark, sf_dir)
    return e.filter("event_type = 'purchase'").select("user_id").union(e.filter("fresh and event_type = 'error'").select("user_id")).distinct()


def last_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user and type, and the value of that user's dearest one."""
    e = table(spark, sf_dir, "events")
    last = R.top_rows(e, ["user_id", "event_type"], _newest()).select("user_id", "event_type", "event_id")
    return last.join(e.groupBy("user_id").agg(F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("dearest")), "user_id")


def type_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user: types before and since the split together, those it lost, and those it never had."""
    e = _events(spark, sf_dir)
    kinds = ("click", "error", "purchase", "signup", "view")
    sets = e.groupBy("user_id").agg(F.collect_set(F.when(~F.col("fresh"), F.col("event_type"))).alias("old"), F.collect_set(F.when(F.col("fresh"), F.col("event_type"))).alias("new"))
    listed = lambda c: F.array_join(F.array_sort(c), ",")
    every = F.array_union("old", "new")
    return sets.select("user_id", listed(every).alias("types"), listed(F.array_except("old", "new")).alias("lost"), listed(F.array_except(F.array(*[F.lit(k) for k in kinds]), every)).alias("missing"))


def stored_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by content: one file for each digest, with its size, first page and number of pages."""
    h = F.coalesce("html", F.lit(""))
    return table(spark, sf_dir, "pages").groupBy(F.sha2(h, 256).alias("sha256")).agg(F.min(F.octet_length(h)).cast("long").alias("bytes"), F.min("page_id").alias("first_page"), F.count(F.lit(1)).alias("pages"))


def piped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of name, price and pack between bars, read again: fields, and what is wrong with a line."""
    k = F.col("p_partkey")
    line = F.concat_ws("|", F.when(k % 11 != 0, F.col("p_name")).otherwise(" "), F.when(k % 7 != 0, k.cast("string")).otherwise("n/a"), F.when(k % 3 != 0, F.col("p_size").cast("string")))
    f = table(spark, sf_dir, "part").select(k, F.split(line, "[|]").alias("f"))
    name, price = F.trim(F.get("f", F.lit(0))), F.expr("try_cast(get(f, 1) AS bigint)")
    wrong = F.when(name == "", "name").when(price.isNull() | (price <= 0), "price")
    return f.select("p_partkey", name.alias("name"), price.alias("price"), F.get("f", F.lit(2)).alias("pack"), wrong.alias("error"))


def inserted_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old events by user and type, and of the new ones those whose user and type are not among them."""
    e = _events(spark, sf_dir).select("user_id", "event_type", "event_id", "fresh")
    return R.insert_absent(e.filter("not fresh and event_id % 4 = 0"), e.filter("fresh"), ["user_id", "event_type"]).select("user_id", "event_type", "event_id")


def replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of users and days, where those that came in last replace all of the same user and day."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.to_date("ts").alias("day"))
    return R.replace_keys(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), ["user_id", "day"])


def merged_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by product after products of one name were merged into the first of them."""
    part = table(spark, sf_dir, "part")
    keep = part.groupBy("p_name").agg(F.min("p_partkey").alias("new"))
    mapping = part.join(keep, "p_name").filter("p_partkey <> new").select(F.col("p_partkey").alias("old"), "new")
    moved = R.relink(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity"), mapping, "l_partkey")
    return moved.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").alias("quantity"))


def enqueued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs after new requests: one active job for each user and type; a request for one that is there lowers its priority at most, another one makes it.

    Jobs that are done (purchases) aren't active, so a request makes a new one."""
    e = _events(spark, sf_dir).withColumn("p", (F.col("event_id") % 9).cast("int"))
    least = lambda cond, out: e.filter(cond).groupBy("user_id", "event_type").agg(F.min("p").alias(out))
    both = least("not fresh and event_type <> 'purchase'", "old").join(least("fresh", "new"), ["user_id", "event_type"], "full_outer")
    return both.select("user_id", "event_type", F.least("old", "new").alias("priority"), F.col("old").isNull().alias("created"))


def deactivated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers, active if they have a line among those accepted."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey")
    accepted = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'A' and l_quantity >= 49 and l_discount < 0.02").select(F.col("l_suppkey").alias("s_suppkey")).distinct().withColumn("hit", F.lit(True))
    return s.join(accepted, "s_suppkey", "left").select("s_suppkey", F.coalesce("hit", F.lit(False)).alias("active"))


def scan_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a repeated scan of each customer's order would do: missing, created, duplicate or restored."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "O").alias("open"), F.count(F.lit(1)).alias("n"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.select("c_custkey", F.when(F.col("c_acctbal") < 0, "missing").when(F.col("n").isNull(), "created").when(F.col("open") > 0, "duplicate").otherwise("restored").alias("outcome"))


def clear_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per customer the order with the best score, unless another one comes within five points."""
    o = table(spark, sf_dir, "orders").withColumn("score", F.floor(F.col("o_totalprice") / 5000))
    two = R.top_rows(o.select("o_custkey", "o_orderkey", "score"), ["o_custkey"], [F.col("score").desc(), F.col("o_orderkey")], 2, "r")
    best = two.groupBy("o_custkey").agg(F.max(F.when(F.col("r") == 1, F.col("o_orderkey"))).alias("winner"), F.max(F.when(F.col("r") == 1, F.col("score"))).alias("score"), F.max(F.when(F.col("r") == 2, F.col("score"))).alias("runner_up"))
    return best.select("o_custkey", "score", F.when(F.col("runner_up").isNull() | (F.col("score") - F.col("runner_up") > 5), F.col("winner")).alias("winner"))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers claimed by products: conflicting names, several products of one number, or verified."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.expr("p_partkey div 3").alias("number"), "p_size")
    n = p.filter("id % 4 <> 0").groupBy("number").agg(F.count(F.lit(1)).alias("n"))
    state = F.when(F.col("p_size") < 5, "CONFLICT").when(F.coalesce("n", F.lit(0)) > 1, "REVIEW").when(F.col("id") % 4 == 0, "PROVISIONAL").otherwise("VERIFIED")
    return p.join(n, "number", "left").select("id", "number", state.alias("state"))


def weighted_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user the type with most weight of evidence; of equals that with more sources, then the first by name."""
    weights = F.create_map(*[F.lit(x) for pair in {"purchase": 100, "signup": 90, "click": 60, "view": 55, "error": 45}.items() for x in pair])
    each = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.sum(weights[F.col("event_type")]).alias("weight"), F.countDistinct(F.to_date("ts")).alias("sources"))
    return R.top_rows(each, ["user_id"], [F.col("weight").desc(), F.col("sources").desc(), F.col("event_type")])


_ROW = "QUALIFY row_number() OVER (PARTITION BY {0} ORDER BY {1}) = 1"
QUERIES = {
    "series": (series, f"WITH {E} SELECT ts, user_id, max(value) FILTER (event_type = 'click') AS click, max(value) FILTER (event_type = 'view') AS view FROM e WHERE fresh AND event_type IN ('click', 'view') GROUP BY ts, user_id"),
    "customer_orders": (customer_orders, "SELECT c_custkey, n AS open_orders, first_order, last_order FROM customer LEFT JOIN LATERAL (SELECT count(*) AS n, min(o_orderkey) AS first_order, max(o_orderkey) AS last_order FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') ON true"),
    "largest_orders": (largest_orders, "SELECT o_orderkey, o_custkey FROM orders o WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)"),
    "overview": (overview, "SELECT (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS open_orders, (SELECT count(*) FROM customer WHERE c_acctbal < 0) AS in_debt, (SELECT count(*) FROM part WHERE p_size > 45) AS large_parts, (SELECT count(*) FROM events WHERE event_type = 'error') AS errors"),
    "families": (families, f"""WITH f AS (SELECT DISTINCT string_split(p_name, ' ')[-1] AS family FROM part WHERE p_partkey % 7 = 0 UNION SELECT p_name FROM part WHERE p_partkey % 50 = 0)
SELECT p_name, family FROM (SELECT DISTINCT p_name FROM part) JOIN f ON p_name = family OR ends_with(p_name, ' ' || family) {_ROW.format("p_name", "length(family) DESC")}"""),
    "panels": (panels, """WITH n AS (SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN p_size + 100 END AS panel, CASE WHEN p_partkey % 4 = 0 THEN p_type END AS tag FROM part WHERE p_partkey % 2 = 0)
SELECT p.p_partkey, coalesce(panel, CASE WHEN p.p_partkey % 3 <> 0 THEN p_size END) AS size, coalesce(tag, 'own') AS tag FROM part p LEFT JOIN n USING (p_partkey)"""),
    "first_known": (first_known, f"WITH {E} SELECT user_id, arg_max(a, (ts, event_id)) FILTER (a IS NOT NULL) AS a, arg_max(b, (ts, event_id)) FILTER (b IS NOT NULL) AS b FROM e GROUP BY user_id"),
    "best_record": (best_record, f"WITH {E}, l AS (SELECT * FROM e {_ROW.format('user_id, event_type', 'ts DESC, event_id DESC')}), s AS (SELECT *, CASE WHEN a IS NULL THEN 0 ELSE 2 END + CASE WHEN b IS NULL THEN 0 ELSE 1 END AS score FROM l) SELECT user_id, event_type, event_id, score FROM s {_ROW.format('user_id', 'score DESC, event_id')}"),
    "voted_day": (voted_day, f"WITH v AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS votes, max(value) AS top FROM events GROUP BY 1, 2) SELECT * FROM v {_ROW.format('user_id', 'votes DESC, top DESC, day DESC')}"),
    "priority_queue": (priority_queue, "SELECT o_orderkey, CASE left(o_orderpriority, 1) WHEN '1' THEN 0 WHEN '2' THEN 1 WHEN '3' THEN 3 WHEN '5' THEN 5 ELSE 9 END AS urgency FROM orders WHERE o_orderstatus = 'O' ORDER BY urgency, o_orderdate, o_orderkey LIMIT 500"),
    "ranked_search": (ranked_search, """WITH c AS (SELECT c_custkey, regexp_replace(lower(c_name), '^customer#0*', '') AS n, c_nationkey, lower(c_mktsegment) AS m FROM customer),
r AS (SELECT c_custkey, CASE WHEN c_custkey = 12 THEN 0 WHEN c_nationkey = 12 THEN 1 WHEN n = '12' THEN 2 WHEN starts_with(n, '12') THEN 3 WHEN contains(n, '12') THEN 4 WHEN contains(m, '12') THEN 5 END AS rank FROM c) SELECT * FROM r WHERE rank IS NOT NULL ORDER BY rank, c_custkey LIMIT 100"""),
    "next_jobs": (next_jobs, f"WITH e AS (SELECT *, CAST(trunc(value % 7) AS INT) AS priority FROM events) SELECT event_type, event_id, priority FROM e {_ROW.format('event_type', 'priority, ts, event_id')}"),
    "piped_imports": (piped_imports, """WITH l AS (SELECT p_brand, p_size, p_partkey % 211 = 0 OR p_partkey % 97 = 0 AS bad, CASE WHEN p_partkey % 97 <> 0 THEN p_partkey::DOUBLE ELSE -1.0 END AS price, p_partkey % 3 = 0 AS special FROM part),
g AS (SELECT p_brand, p_size, count(*) AS lines, count(*) FILTER (bad) AS errors, count(*) FILTER (special) AS specials, sum(price) AS total FROM l GROUP BY 1, 2) SELECT *, CASE WHEN errors = 0 THEN lines ELSE 0 END AS accepted FROM g"""),
    "unresolved": (unresolved, "SELECT 'event' AS source, event_id AS id FROM events WHERE event_id % 3 = 0 UNION ALL SELECT 'part', p_partkey FROM part WHERE p_partkey % 5 = 0 UNION ALL SELECT 'customer', c_custkey FROM customer WHERE c_acctbal < 0"),
    "active_users": (active_users, f"SELECT user_id FROM events WHERE event_type = 'purchase' UNION SELECT user_id FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '{SPLIT}'"),
    "last_per_key": (last_per_key, f"WITH d AS (SELECT user_id, event_id AS dearest FROM events {_ROW.format('user_id', 'value DESC, event_id')}) SELECT user_id, event_type, event_id, dearest FROM (SELECT * FROM events {_ROW.format('user_id, event_type', 'ts DESC, event_id DESC')}) JOIN d USING (user_id)"),
    "type_sets": (type_sets, f"""WITH {E}, s AS (SELECT user_id, coalesce(list(DISTINCT event_type) FILTER (NOT fresh), []) AS o, coalesce(list(DISTINCT event_type) FILTER (fresh), []) AS n, list(DISTINCT event_type) AS u FROM e GROUP BY user_id)
SELECT user_id, array_to_string(list_sort(u), ',') AS types, array_to_string(list_sort(list_filter(o, lambda x: NOT list_contains(n, x))), ',') AS lost, array_to_string(list_filter(['click', 'error', 'purchase', 'signup', 'view'], lambda x: NOT list_contains(u, x)), ',') AS missing FROM s"""),
    "stored_files": (stored_files, "SELECT sha256(coalesce(html, '')) AS sha256, min(strlen(coalesce(html, ''))) AS bytes, min(page_id) AS first_page, count(*) AS pages FROM pages GROUP BY 1"),
    "piped_lines": (piped_lines, """SELECT p_partkey, CASE WHEN p_partkey % 11 <> 0 THEN p_name ELSE '' END AS name, CASE WHEN p_partkey % 7 <> 0 THEN p_partkey END AS price, CASE WHEN p_partkey % 3 <> 0 THEN CAST(p_size AS VARCHAR) END AS pack,
  CASE WHEN p_partkey % 11 = 0 THEN 'name' WHEN p_partkey % 7 = 0 THEN 'price' END AS error FROM part"""),
    "inserted_absent": (inserted_absent, f"""WITH {E}, o AS (SELECT user_id, event_type, event_id FROM e WHERE NOT fresh AND event_id % 4 = 0)
SELECT * FROM o UNION ALL (SELECT user_id, event_type, min(event_id) FROM e WHERE fresh AND (user_id, event_type) NOT IN (SELECT (user_id, event_type) FROM o) GROUP BY ALL)"""),
    "replaced": (replaced, "WITH e AS (SELECT event_id, user_id, CAST(ts AS DATE) AS day FROM events), n AS (SELECT * FROM e WHERE event_id % 2 = 1) SELECT * FROM e WHERE event_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM n WHERE n.user_id = e.user_id AND n.day = e.day) UNION ALL SELECT * FROM n"),
    "merged_products": (merged_products, "SELECT k AS l_partkey, count(*) AS lines, sum(l_quantity) AS quantity FROM lineitem JOIN (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_name) AS k FROM part) ON l_partkey = p_partkey GROUP BY k"),
    "enqueued": (enqueued, f"""WITH {E}, o AS (SELECT user_id, event_type, CAST(min(event_id % 9) AS INT) AS p FROM e WHERE NOT fresh AND event_type <> 'purchase' GROUP BY 1, 2), n AS (SELECT user_id, event_type, CAST(min(event_id % 9) AS INT) AS p FROM e WHERE fresh GROUP BY 1, 2)
SELECT user_id, event_type, least(o.p, n.p) AS priority, o.p IS NULL AS created FROM o FULL JOIN n USING (user_id, event_type)"""),
    "deactivated": (deactivated, "SELECT s_suppkey, EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = 'A' AND l_quantity >= 49 AND l_discount < 0.02) AS active FROM supplier"),
    "scan_outcomes": (scan_outcomes, "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'missing' WHEN count(o_orderkey) = 0 THEN 'created' WHEN count(*) FILTER (o_orderstatus = 'O') > 0 THEN 'duplicate' ELSE 'restored' END AS outcome FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_acctbal"),
    "clear_winner": (clear_winner, f"""WITH s AS (SELECT o_custkey, o_orderkey, CAST(floor(o_totalprice / 5000) AS BIGINT) AS score FROM orders), l AS (SELECT *, lead(score) OVER (PARTITION BY o_custkey ORDER BY score DESC, o_orderkey) AS next FROM s {_ROW.format('o_custkey', 'score DESC, o_orderkey')})
SELECT o_custkey, score, CASE WHEN next IS NULL OR score - next > 5 THEN o_orderkey END AS winner FROM l"""),
    "claims": (claims, """WITH n AS (SELECT p_partkey // 3 AS number, count(*) AS n FROM part WHERE p_partkey % 4 <> 0 GROUP BY 1)
SELECT p_partkey AS id, p_partkey // 3 AS number, CASE WHEN p_size < 5 THEN 'CONFLICT' WHEN n > 1 THEN 'REVIEW' WHEN p_partkey % 4 = 0 THEN 'PROVISIONAL' ELSE 'VERIFIED' END AS state FROM part LEFT JOIN n ON p_partkey // 3 = number"""),
    "weighted_vote": (weighted_vote, f"""WITH v AS (SELECT user_id, event_type, CAST(sum(CASE event_type WHEN 'purchase' THEN 100 WHEN 'signup' THEN 90 WHEN 'click' THEN 60 WHEN 'view' THEN 55 ELSE 45 END) AS BIGINT) AS weight, count(DISTINCT CAST(ts AS DATE)) AS sources FROM events GROUP BY ALL)
SELECT * FROM v {_ROW.format('user_id', 'weight DESC, sources DESC, event_type')}"""),
}
