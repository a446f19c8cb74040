"""Receipts of several hundred lines, read line by line: purchases, and where these begin and end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.functions import parsing as P
from basketry.plans.fixtures import spread, table


def printed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What suppliers' receipts say: a receipt for each supplier, whose lines tell of its order lines in ten ways; r, num and line."""
    c = F.col
    cents = F.floor(c("l_extendedprice") * 100 + 0.5)
    amount = lambda x: F.concat(F.floor(x / 100).cast("string"), F.lit("."), F.lpad((x % 100).cast("string"), 2, "0"))
    told = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    rows = spread(told).join(table(spark, sf_dir, "part"), c("l_partkey") == c("p_partkey"))
    rows = rows.select(c("l_suppkey").alias("r"), (c("l_orderkey") * 1000 + c("l_linenumber") * 10).alias("num"), c("p_name").alias("name"), amount(cents).alias("price"), amount(F.floor(cents / c("l_quantity"))).alias("unit"), c("l_quantity").cast("int").cast("string").alias("q"), ((c("l_quantity") + c("l_linenumber")) % 10).cast("int").alias("form"))
    cat = lambda *x: F.concat(*[c(v[1:]) if v.startswith("$") and len(v) > 1 and v[1:].isalpha() else F.lit(v) for v in x])
    forms = [[cat(*line) for line in form] for form in FORMS]
    # a row makes the lines of its own form only
    said = F.coalesce(*[F.when(c("form") == i, F.array(*form)) for i, form in enumerate(forms)])
    body = rows.select("r", "num", F.posexplode(said).alias("i", "line")).select("r", (c("num") + c("i")).alias("num"), "line")
    shops = table(spark, sf_dir, "supplier").select(c("s_suppkey").alias("r"))
    ends = F.array(*[F.struct(F.lit(n).cast("long").alias("num"), F.lit(t).alias("line")) for n, t in FRAME])
    frame = shops.select("r", F.explode(F.concat(ends, F.array(F.struct(F.lit(-1).cast("long").alias("num"), F.when(c("r") % 4 == 1, "The fresh food people").when(c("r") % 4 == 2, "POS 065 TRANS 2646").otherwise("Description $").alias("line"))))).alias("x")).select("r", "x.*")
    return body.unionByName(frame)


#: Forms of an order line: names of columns behind a dollar sign.
FORMS = (
    (("$name", " ", "$price"),), (("$name",), ("Qty ", "$q", " @ $", "$unit", " each  ", "$price")), (("x ", "$name"), ("$q", " @ ", "$unit", " EACH")), (("%", "$name", " ", "$price"), ("$q", " @ $", "$unit")),
    (("2 x ", "$name", " 500g"), ("$", "$price")), (("^PROMOTIONAL PRICE",), ("$name", " 2kg")), (("$name", " 2 FOR $3.00"), ("$price",)), (("SUBTOTAL ", "$price"), ("{", "$name", "|")),
    (("$name",), ("Special offer",), ("Qty 1 @ ", "$unit")), (("* ", "$price"), ("EA 1.00",), ("=====",)),
)
#: What stands before and behind the order lines.
FRAME = ((-3, "Woolworths"), (-2, "TAX INVOICE 12.00"), (10**15, "TOTAL $12.34"), (10**15 + 1, "VISA 12.34"), (10**15 + 2, "Late Item 1.00"))


def receipt_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases of all receipts: a state machine over their lines, as running windows."""
    return P.purchases(printed_lines(spark, sf_dir), "r", "num", "line")


def receipt_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the purchases of all receipts begin and end."""
    return P.regions(printed_lines(spark, sf_dir), "r", "num", "line")


def _form_sql(form: tuple) -> str:
    one = lambda parts: " || ".join(v[1:] if v.startswith("$") and v[1:].isalpha() else f"'{v}'" for v in parts)
    return "[" + ", ".join(one(line) for line in form) + "]"


def _says(c: str, *patterns: str) -> str:
    return f"regexp_matches({c}, '(?i)" + "|".join(f"(?:{p})" for p in patterns).replace("'", "''") + "')"


def _clean(c: str) -> str:
    for pattern, to in P.CLEANED:
        c = f"regexp_replace({c}, '{pattern.replace(chr(39), chr(39) * 2)}', '{to.replace('$', chr(92))}', 'g')"
    return f"trim({c})"


def _saleable(c: str) -> str:
    return f"(length({c}) >= 2 AND regexp_matches({c}, '(?i)[a-z]') AND NOT {_says(c, *P.HARD_STOPS, *P.IGNORED, P.SUMMARY)})"


_MONEY = "CAST(replace(regexp_replace({0}, '[\\s$]', '', 'g'), ',', '.') AS DOUBLE)"
LINES_SQL = f"""body AS (
  SELECT l_suppkey AS r, l_orderkey * 1000 + l_linenumber * 10 AS num, p_name AS name, c // 100 || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') AS price, u // 100 || '.' || lpad(CAST(u % 100 AS VARCHAR), 2, '0') AS unit,
    CAST(CAST(l_quantity AS INT) AS VARCHAR) AS q, CAST((l_quantity + l_linenumber) % 10 AS INT) AS form
  FROM (SELECT *, CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS c, CAST(floor(floor(l_extendedprice * 100 + 0.5) / l_quantity) AS BIGINT) AS u FROM lineitem) JOIN part ON l_partkey = p_partkey),
said AS (SELECT r, num, CASE form {" ".join(f"WHEN {i} THEN {_form_sql(f)}" for i, f in enumerate(FORMS))} END AS x FROM body),
printed AS (
  SELECT r, num + i - 1 AS num, x[i] AS line FROM (SELECT r, num, x, unnest(range(1, len(x) + 1)) AS i FROM said)
  UNION ALL SELECT s_suppkey, num, line FROM supplier, (VALUES {", ".join(f"({n}, '{t}')" for n, t in FRAME)}) f(num, line)
  UNION ALL SELECT s_suppkey, -1, CASE s_suppkey % 4 WHEN 1 THEN 'The fresh food people' WHEN 2 THEN 'POS 065 TRANS 2646' ELSE 'Description $' END FROM supplier),
rows_ AS MATERIALIZED (SELECT r, num, t, row_number() OVER (PARTITION BY r ORDER BY num, t) - 1 AS i
  FROM (SELECT r, num, trim(regexp_replace(regexp_replace(line, '[|{{}}]', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM printed) WHERE t <> '')"""

_BEFORE = "left(t, length(t) - length(m[-1]) - length(split_part(t, m[-1], -1)))"
PURCHASES_SQL = f"""
WITH RECURSIVE {LINES_SQL},
begun AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY i) AS k FROM (
  SELECT a.r, a.i, a.t, min(CASE WHEN {_says("a.t", P.SUMMARY, *P.HARD_STOPS)} AND NOT {_says("a.t", P.DESCRIPTION)} THEN a.i END) OVER (PARTITION BY a.r) AS stop
  FROM rows_ a JOIN (SELECT r, min(i) AS i FROM rows_ WHERE {_says("t", P.DESCRIPTION)} GROUP BY r) b ON a.r = b.r AND a.i > b.i) WHERE i < coalesce(stop, i + 1) AND NOT {_says("t", P.DESCRIPTION, *P.SKIPPED)}),
seen AS (SELECT r, k, t, regexp_extract_all(t, '{P.MONEY}') AS m, regexp_extract(t, '(?i){P.QUANTITY}', 1) AS a, regexp_extract(t, '(?i){P.QUANTITY}', 2) AS u FROM begun),
parts AS (SELECT *, CASE WHEN len(m) > 0 THEN {_BEFORE} END AS before, CASE WHEN len(m) > 0 THEN {_MONEY.format("m[-1]")} END AS last FROM seen),
kinds AS MATERIALIZED (SELECT r, k, CASE WHEN a <> '' THEN 'Q' WHEN before = '' THEN 'A' WHEN before IS NOT NULL THEN 'P' WHEN NOT {_says("t", *P.IGNORED, P.PROMOTION)} AND regexp_matches(t, '(?i)[a-z]') THEN 'W' ELSE 'O' END AS kind,
    {_clean("t")} AS words, {_clean("before")} AS own, CASE WHEN a <> '' THEN CAST(a AS DOUBLE) ELSE 1 END AS q,
    CASE WHEN a = '' OR len(m) > 1 THEN last ELSE floor(CAST(a AS DOUBLE) * {_MONEY.format("u")} * 100 + 0.5) / 100 END AS p FROM parts),
state(r, k, pending, n, new, q, p, sure) AS (
  SELECT DISTINCT r, CAST(0 AS BIGINT), '', CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), 96 FROM kinds
  UNION ALL
  SELECT r, k, CASE WHEN kind = 'W' THEN words WHEN kind = 'Q' OR new IS NOT NULL THEN '' ELSE pending END, n + CASE WHEN new IS NULL THEN 0 ELSE 1 END, new,
    CASE WHEN new IS NOT NULL OR (kind = 'Q' AND pending = '' AND n > 0) THEN q END, CASE WHEN new IS NOT NULL OR (kind = 'Q' AND pending = '' AND n > 0) THEN p END, CASE WHEN kind = 'Q' THEN 98 ELSE 96 END
  FROM (SELECT *, CASE WHEN d <> '' AND (kind = 'Q' OR NOT {_says("d", "^qty[^a-z0-9_]", "^qty$")}) AND {_saleable("dd")} THEN dd END AS new
    FROM (SELECT *, {_clean("d")} AS dd FROM (SELECT t.r, t.k, t.kind, t.words, t.q, t.p, s.pending, s.n, CASE t.kind WHEN 'P' THEN t.own WHEN 'A' THEN {_clean("s.pending")} WHEN 'Q' THEN s.pending ELSE '' END AS d
      FROM state s JOIN kinds t ON s.r = t.r AND t.k = s.k + 1))))
SELECT r, n AS place, max(new) AS description, arg_max(q, k) AS quantity, arg_max(p, k) AS price, CAST(max(sure) AS INT) AS confidence FROM state WHERE q IS NOT NULL GROUP BY r, n"""

_PRICED = f"""(len(list_filter(list_transform(regexp_extract_all(t, '{P.MONEY}'), lambda v: {_MONEY.format("v")}), lambda v: v > 0)) > 0 AND regexp_matches(t, '(?i)[a-z]{{2,}}')
  AND NOT {_says("t", P.PHOTO_HEADER, P.PHOTO_SUMMARY, P.PHOTO_PAYMENT, P.PHOTO_PROMOTION)})"""
REGIONS_SQL = f"""
WITH RECURSIVE {LINES_SQL},
near AS (SELECT *, lead(t) OVER w AS b, lead(t, 2) OVER w AS c FROM rows_ WINDOW w AS (PARTITION BY r ORDER BY i)),
marks AS (SELECT r, coalesce(min(i) FILTER ((({_says("t", P.PHOTO_COUNT)}) AND ({_says("coalesce(b, '')", P.PHOTO_SUM)} OR {_says("coalesce(c, '')", P.PHOTO_SUM)}))
    OR ({_says("t", P.PHOTO_TOTAL)} AND NOT {_says("t", P.PHOTO_GST)} AND (regexp_matches(t, '{P.MONEY}') OR (regexp_matches(coalesce(b, ''), '{P.MONEY}') AND NOT {_says("coalesce(b, '')", P.PHOTO_PAYMENT)})))), count(*)) AS stop,
  min(i) FILTER ({_says("t", "^description[^a-z0-9_]", "^description$")}) AS heading, min(i) FILTER ({_says("t", P.TRANSACTION)} ) AS trans, bool_or({_says("t", "[^a-z0-9_]woolworths", "^woolworths")}) AS theirs FROM near GROUP BY r),
inside AS (SELECT n.r, n.i, n.t, {_PRICED} AS priced, {_says("t", P.PHOTO_PACK)} AND regexp_matches(t, '(?i)[a-z]{{3,}}') AND NOT {_says("t", P.PHOTO_HEADER, P.PHOTO_SUMMARY)} AS packed,
  {_says("t", P.PHOTO_QUANTITY, P.PHOTO_PROMOTION)} AS goes FROM rows_ n JOIN marks m ON n.r = m.r AND n.i < m.stop),
first AS (SELECT a.r, min(a.i) AS i FROM inside a JOIN inside b ON a.r = b.r AND b.i BETWEEN a.i + 1 AND a.i + 3 AND (b.priced OR b.goes) WHERE a.priced GROUP BY a.r),
back(r, i, steps) AS (SELECT r, i, 0 FROM first UNION ALL SELECT b.r, b.i - 1, steps + 1 FROM back b JOIN inside n ON n.r = b.r AND n.i = b.i - 1 AND n.packed WHERE steps < 3),
start_ AS (SELECT r, min(i) AS i FROM back GROUP BY r)
SELECT m.r, CAST(coalesce(m.heading + 1, CASE WHEN theirs THEN m.trans + 1 END, s.i, m.stop) AS INT) AS start, CAST(m.stop AS INT) AS "end",
  CASE WHEN m.heading IS NOT NULL THEN 'heading' WHEN theirs AND m.trans IS NOT NULL THEN 'transaction' WHEN s.i IS NOT NULL THEN 'merchandise' ELSE 'none' END AS mark
FROM marks m LEFT JOIN start_ s ON m.r = s.r"""

QUERIES = {"receipt_purchases": (receipt_purchases, PURCHASES_SQL), "receipt_regions": (receipt_regions, REGIONS_SQL)}
