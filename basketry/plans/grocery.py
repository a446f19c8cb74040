"""Listings against products, catalogue quality, resolution of products: over groceries derived from the part table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.functions import names as M
from basketry.functions import numbers as N
from basketry.functions import scores as S
from basketry.functions import text as T
from basketry.functions import vocabulary as V
from basketry.functions.retailers import MARKERS, misreadings, retailer_of
from basketry.operators import relational as R
from basketry.plans.fixtures import spread, table

GOODS = ("Full Cream Milk", "Basmati Rice", "Green Apples", "Beef Mince", "Greek Yoghurt", "Olive Oil Spray", "Chocolate Biscuits", "Tomato Sauce", "Sourdough Bread", "Orange Juice", "Frozen Peas", "Dishwashing Tablets", "Lemon Juice", "Lemons")
BRANDS = ("Coles", "Farmland", "Golden Days", "Northern")
PACKS = ("2 L", "500 g", "1 kg", "12 pack", "750 ml", "6 pk", None)
STORED = ("Fresh produce", "Chilled", "International Foods", "Other", None)
#: What is wrong with a product's data follows from its key, so that every rule has something to find.
_LIST = lambda xs: "[" + ", ".join("NULL" if x is None else f"'{x}'" for x in xs) + "]"


def _pick(xs: tuple, at: Column) -> Column:
    return F.get(F.array(*[F.lit(x).cast("string") for x in xs]), (at % len(xs)).cast("int"))


def goods(spark: SparkSession, sf_dir: str, dealt: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Products (of the part table, as dealt): id, name, brand, pack, stored, gtin, produce, image, servings, energy, ingredients, allergens, links, seen."""
    k = F.col("p_partkey")
    body = F.lpad(k.cast("string"), 12, "0")
    return dealt(table(spark, sf_dir, "part").select(k, "p_retailprice")).select(
        k.alias("id"), _pick(GOODS, k).alias("name"), F.when(k % 5 != 0, _pick(BRANDS, k)).alias("brand"), _pick(PACKS, k).alias("pack"), _pick(STORED, k).alias("stored"), F.when(k % 3 != 0, N.with_check_digit(body)).alias("gtin"),
        (k % 13 == 0).alias("produce"), F.when(k % 7 != 0, F.concat(F.lit("https://x/"), k.cast("string"))).alias("image"), F.when(k % 4 != 0, (k % 701).cast("double")).alias("servings"), F.when(k % 11 != 0, F.when(k % 23 == 0, -1.0).otherwise(F.col("p_retailprice"))).alias("energy"),
        F.when(k % 9 == 0, "n/a").when(k % 8 != 0, F.lit("milk, wheat flour and salt")).alias("ingredients"), (k % 6).cast("int").alias("allergens"), (k % 4).cast("int").alias("links"), F.col("p_retailprice").alias("price"), (k * 7 % 1000).alias("seen"),
    )


GOODS_SQL = f"""goods AS (SELECT *, CASE WHEN id % 3 <> 0 THEN body || CAST((10 - (SELECT sum(CAST(body[13 - i] AS INT) * CASE WHEN i % 2 = 1 THEN 3 ELSE 1 END) FROM range(1, 13) t(i)) % 10) % 10 AS VARCHAR) END AS gtin FROM (
  SELECT p_partkey AS id, {_LIST(GOODS)}[CAST(p_partkey % {len(GOODS)} AS INT) + 1] AS name, CASE WHEN p_partkey % 5 <> 0 THEN {_LIST(BRANDS)}[CAST(p_partkey % 4 AS INT) + 1] END AS brand, {_LIST(PACKS)}[CAST(p_partkey % 7 AS INT) + 1] AS pack,
    {_LIST(STORED)}[CAST(p_partkey % 5 AS INT) + 1] AS stored, lpad(CAST(p_partkey AS VARCHAR), 12, '0') AS body, p_partkey % 13 = 0 AS produce, CASE WHEN p_partkey % 7 <> 0 THEN 'https://x/' || p_partkey END AS image,
    CASE WHEN p_partkey % 4 <> 0 THEN CAST(p_partkey % 701 AS DOUBLE) END AS servings, CASE WHEN p_partkey % 11 <> 0 THEN CASE WHEN p_partkey % 23 = 0 THEN -1.0 ELSE p_retailprice END END AS energy,
    CASE WHEN p_partkey % 9 = 0 THEN 'n/a' WHEN p_partkey % 8 <> 0 THEN 'milk, wheat flour and salt' END AS ingredients, CAST(p_partkey % 6 AS INT) AS allergens, CAST(p_partkey % 4 AS INT) AS links, p_retailprice AS price, p_partkey * 7 % 1000 AS seen FROM part))"""


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a search for each product finds: four listings of two retailers, of the product or of others."""
    k, j = F.col("id"), F.col("j")
    g = goods(spark, sf_dir, spread).withColumn("j", F.explode(F.array(*[F.lit(i) for i in range(4)])))
    name = F.when(j == 0, F.concat_ws(" ", "brand", "name", "pack")).when(j == 1, F.concat_ws(" ", "name", F.lit("Value"), "pack")).when(j == 2, F.concat_ws(" ", "brand", _pick(GOODS, k + 1))).otherwise(F.upper("name"))
    number = F.when((j == 0) & (k % 2 == 0), F.col("gtin")).when((j == 1) & (k % 6 == 1), "12345670").when(j == 3, "4006381333931")
    return g.withColumns({"other": name, "other_pack": F.when(j == 0, F.col("pack")).when(j == 1, _pick(PACKS, k + 1)), "other_gtin": number, "retailer": F.when(j % 2 == 0, "Coles").otherwise("Woolworths"), "external": F.when((k + j) % 4 != 0, k * 10 + j), "offer": F.col("price") + j})


LISTINGS_SQL = f"""{GOODS_SQL}, listings AS (SELECT *, CASE j WHEN 0 THEN concat_ws(' ', brand, name, pack) WHEN 1 THEN concat_ws(' ', name, 'Value', pack) WHEN 2 THEN concat_ws(' ', brand, {_LIST(GOODS)}[CAST((id + 1) % {len(GOODS)} AS INT) + 1]) ELSE upper(name) END AS other,
  CASE j WHEN 0 THEN pack WHEN 1 THEN {_LIST(PACKS)}[CAST((id + 1) % 7 AS INT) + 1] END AS other_pack, CASE WHEN j = 0 AND id % 2 = 0 THEN gtin WHEN j = 1 AND id % 6 = 1 THEN '12345670' WHEN j = 3 THEN '4006381333931' END AS other_gtin,
  CASE WHEN j % 2 = 0 THEN 'Coles' ELSE 'Woolworths' END AS retailer, CASE WHEN (id + j) % 4 <> 0 THEN id * 10 + j END AS external, price + j AS offer FROM goods, range(4) r(j))"""
_PLAIN = "trim(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9.]+', ' ', 'g'))"
_LONG = "list_filter(string_split({0}, ' '), lambda w: length(w) > 1)"
_SHARE = "CASE WHEN len({0}) > 0 THEN len(list_filter({0}, lambda w: list_contains({1}, w))) / len({0}) ELSE 0.0 END"
_TOKENS = "list_distinct(list_transform(list_filter(string_split(trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: length(w) > 1), lambda w: CASE WHEN length(w) > 3 AND w LIKE '%s' THEN w[:-2] ELSE w END))"
_UNITS = {"kg": ("1000", "g"), "g": ("1", "g"), "l": ("1000", "ml"), "ml": ("1", "ml"), "pack": ("1", "pack"), "pk": ("1", "pack")}


def _pack_sql(c: str) -> str:
    n = _PLAIN.format(c)
    amount, unit = (f"regexp_extract({n}, '([0-9]+(?:\\.[0-9]+)?) *(kg|g|l|ml|pack|pk)', {i})" for i in (1, 2))
    factor = "CASE " + " ".join(f"WHEN {unit} = '{u}' THEN {f}" for u, (f, _) in _UNITS.items()) + " END"
    base = "CASE " + " ".join(f"WHEN {unit} = '{u}' THEN '{b}'" for u, (_, b) in _UNITS.items()) + " END"
    return f"CASE WHEN {amount} <> '' THEN CAST(CAST(try_cast({amount} AS DOUBLE) * {factor} AS BIGINT) AS VARCHAR) || {base} END"


def live_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per product and retailer: the offer that fits best, substitutes allowed; the cheaper of equals."""
    c = F.col
    rows = listings(spark, sf_dir).withColumn("s", S.live_score(c("name"), c("brand"), c("pack"), c("gtin"), c("other"), c("other_pack"), c("other_gtin"), True)).filter("s is not null")
    best = R.top_rows(rows, ["id", "retailer"], [c("s.score").desc(), c("offer"), c("j")])
    return best.select("id", "retailer", "j", N.round_half_up(c("s.score"), 3).alias("score"), c("s.exact").alias("exact"))


def accepted_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per product and retailer: the listing that is most surely the product, if its number is the same or, without a number, its score is 900 or more."""
    c = F.col
    bonus = F.when(c("retailer") == "Coles", 120).otherwise(0) + F.when(c("external").isNotNull(), 80).otherwise(0) + F.when(c("image").isNotNull(), 40).otherwise(0)
    rows = listings(spark, sf_dir).withColumn("score", S.listing_score(c("name"), c("brand"), c("pack"), c("gtin"), c("other"), c("other_pack"), c("other_gtin"), bonus))
    best = R.top_rows(rows, ["id", "retailer"], [c("score").desc_nulls_last(), c("j")])
    sure = F.when(c("gtin").isNotNull(), F.coalesce(c("gtin") == c("other_gtin"), F.lit(False))).otherwise(c("score") >= 900)
    return best.filter(sure).select("id", "retailer", "j", N.round_half_up(c("score"), 3).alias("score"))


def barcode_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per product: the listing with a valid number that scores 0.82 or more and best."""
    c = F.col
    score = S.candidate_score(c("name"), c("brand"), c("pack"), c("other"), c("other_pack"), c("other_gtin"))
    rows = listings(spark, sf_dir).withColumn("score", N.round_half_up(score, 6)).filter("score >= 0.82")
    return R.top_rows(rows, ["id"], [c("score").desc(), c("j")]).select("id", "j", "score")


def external_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per product: the most complete record of its listings, and whether it wins clearly: by five points, or over the same listing."""
    c = F.col
    score = S.record_score(F.lit(60) + c("j") * 3, c("other"), c("energy"), brand=c("brand"), image=c("image"), pack=c("other_pack"), category=c("stored"), description=c("ingredients"))
    two = R.top_rows(listings(spark, sf_dir).withColumn("score", score), ["id"], [c("score").desc(), c("j")], 2, "r")
    at = lambda r, x: F.max(F.when(c("r") == r, c(x)))
    ends = two.groupBy("id").agg(at(1, "j").alias("j"), at(1, "score").alias("score"), at(2, "score").alias("runner_up"), at(1, "external").alias("e1"), at(2, "external").alias("e2"))
    return ends.select("id", "j", "score", (c("runner_up").isNull() | (c("score") - c("runner_up") >= 5) | F.coalesce(c("e1") == c("e2"), F.lit(False))).alias("clear"))


def gtin_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of numbers by products: invalid, in conflict with the product, held by several products (all for review), verified or provisional."""
    c, k = F.col, F.col("id")
    claims = goods(spark, sf_dir).select("id", "name", "brand", "pack", F.when(k % 10 == 3, F.lit("12345")).when(k % 10 == 6, F.lit("4006381333931")).otherwise(c("gtin")).alias("number"), F.when(k % 17 == 0, F.lit("Garden Hose")).otherwise(c("name")).alias("claimed"), _pick(BRANDS, k + (k % 19 == 0).cast("int")).alias("claimed_brand"), F.when(k % 4 != 0, c("pack")).alias("claimed_pack")).filter("number is not null")
    valid = claims.withColumn("valid", N.gtin_valid(c("number")))
    holders = valid.filter("valid").groupBy("number").agg(F.countDistinct("id").alias("holders"))
    status = S.claim_status(c("name"), c("brand"), c("pack"), c("claimed"), c("claimed_brand"), c("claimed_pack"), k % 2 == 0)
    return valid.join(holders, "number", "left").select("id", "number", F.when(~c("valid"), "INVALID").when(c("holders") > 1, "REVIEW").otherwise(status).alias("status"))


RETAILERS = tuple(MARKERS)


def misread_retailers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' lines as a scanner reads them, and the retailer that a line names, by its marks or but for a few letters."""
    k = F.col("s_suppkey")
    names = F.array(*[F.lit(r) for r in RETAILERS])
    name = F.get(names, (k % len(RETAILERS)).cast("int"))
    line = F.when(k % 4 == 0, F.concat(F.lit("** "), F.upper(F.substring(name, 2, 20)), F.lit(" 12"))).when(k % 4 == 1, F.concat(name, F.lit("x"))).when(k % 4 == 2, F.concat("s_name", F.lit(" "), F.upper(name), F.lit(" stores"))).otherwise(F.concat(F.lit("everyday "), F.reverse(name)))
    return table(spark, sf_dir, "supplier").select(k, line.alias("line")).select("s_suppkey", "line", retailer_of(F.col("line")).alias("retailer"))


def image_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images by what is known of their files: two scores."""
    k = F.col("p_partkey")
    kind, size, w, h = F.when(k % 6 == 0, "text/html").when(k % 9 != 0, "image/png"), F.when(k % 7 != 0, k * 37 % 90_000), F.when(k % 5 != 0, (k * 13 % 1500 + 40).cast("double")), F.when(k % 5 != 1, (k * 29 % 1500 + 40).cast("double"))
    return table(spark, sf_dir, "part").select(k.alias("id"), S.image_score(k % 10 != 0, kind, size, w, h).alias("score"), S.sourced_image_score(_pick(("retailer", "manufacturer", "open-food-facts", "current", "web"), k), size, w, h).alias("sourced"))


def image_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings' names against a product's full name: as an image of produce, and as one of a packaged product."""
    c = F.col
    rows = listings(spark, sf_dir).withColumn("full", F.concat_ws(" ", "brand", "name", "pack"))
    a, b, own = T.name_tokens(c("full")), T.name_tokens(c("other")), c("retailer") == "Coles"
    return rows.select("id", "j", S.produce_image_score(a, b, own).alias("produce"), S.packaged_image_score(a, b, own, c("full"), c("other")).alias("packaged"))


def _sub_scores(g: DataFrame) -> DataFrame:
    c = F.col
    known = lambda x: c(x).isNotNull()
    fields = {"gtin": known("gtin"), "canonicalName": known("name"), "brand": known("brand"), "packSize": known("pack"), "servingsPerPackage": known("servings"), "energyPer100": known("energy"), "ingredients": known("ingredients"), "containsAllergens": c("allergens") > 0, "retailerListing": c("links") > 0, "image": known("image"), "category": known("stored")}
    produce = c("produce")
    packed = [f for f in fields if f != "category"]
    missing = F.array_compact(F.array(*[F.when(~fields[f] & F.when(produce, f in ("canonicalName", "category")).otherwise(f in packed), F.lit(f)) for f in fields]))
    scores = {
        "identity": F.when(produce, S.percentage(fields["canonicalName"], fields["category"])).otherwise(S.percentage(*[fields[f] for f in ("gtin", "canonicalName", "brand", "packSize")], c("id") % 2 == 0)),
        "nutrition": F.when(produce, 100).otherwise(S.percentage(fields["servingsPerPackage"], fields["energyPer100"])), "label": F.when(produce, 100).otherwise(S.percentage(fields["ingredients"], fields["containsAllergens"])),
        "retail": F.when(produce, 100).otherwise(S.percentage(fields["retailerListing"], c("links") > 1)), "photo": F.when(produce | fields["image"], 100).otherwise(0),
    }
    scored = g.withColumns(scores | {"missing": missing})
    whole = F.when(produce, F.floor((c("identity") * 3 + 700) / 10 + 0.5)).otherwise(F.floor((c("identity") * 3 + c("nutrition") * 3 + c("label") * 2 + c("retail") + c("photo")) / 10 + 0.5))
    return scored.withColumn("overall", whole.cast("int"))


def sub_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per product: scores of identity, nutrition, label, retail and photo, their weighted mean, and the fields that are missing."""
    return _sub_scores(goods(spark, sf_dir)).select("id", "identity", "nutrition", "label", "retail", "photo", "overall", F.array_join("missing", ",").alias("missing"))


def repair_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred most urgent repairs: a reason for each missing field, in capitals, by the score they weigh on; one for each product and reason."""
    reasons = _sub_scores(goods(spark, sf_dir)).select("id", F.explode(F.array_distinct("missing")).alias("field"), (100 - F.least(F.lit(80), F.col("overall"))).alias("priority"))
    return reasons.select("id", F.concat(F.lit("MISSING_"), T.upper_snake(F.col("field"))).alias("reason"), "priority").orderBy(F.col("priority").desc(), "id", "reason").limit(100)


def review_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many products each of the review's filters leaves."""
    below = lambda x: F.col(x) < 100
    filters = {"identity": below("identity"), "nutrition": below("nutrition"), "label": below("label"), "retail": below("retail"), "image": below("photo"), "review": F.size("missing") > 0}
    row = _sub_scores(goods(spark, sf_dir)).agg(*[F.count_if(p).alias(k) for k, p in filters.items()])
    return row.unpivot([], list(filters), "filter", "products")


def catalogue_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per product: what is wrong with its listed name and image, and a score."""
    c = F.col
    g = goods(spark, sf_dir).withColumn("listed", F.when(c("id") % 4 == 0, F.concat_ws(" ", "brand", "name", "pack")).when(c("id") % 4 == 1, F.concat(F.lit("WW "), F.lower("name"))).otherwise(c("name")))
    found = R.issues(("RETAILER_IN_NAME", M.has_words(c("listed"), "coles|woolworths|aldi|costco")), ("PACK_SIZE_IN_NAME", c("listed").rlike(r"(?i)\b[0-9]+(?:\.[0-9]+)? *(?:kg|g|ml|l)\b")), ("RECEIPT_ABBREVIATION", M.has_words(c("listed"), "ww|slcd|pk")), ("SUSPICIOUS_IMAGE", F.coalesce(c("image").rlike("9$"), F.lit(False))), ("MISSING_IMAGE", c("image").isNull()))
    weights = {"RETAILER_IN_NAME": 15, "PACK_SIZE_IN_NAME": 15, "RECEIPT_ABBREVIATION": 15, "SUSPICIOUS_IMAGE": 35, "MISSING_IMAGE": 5}
    return g.withColumn("issues", found).select("id", F.array_join("issues", ",").alias("issues"), R.penalty_score(c("issues"), weights).alias("score"))


DEDUCTIONS = {"serving": 15, "servings": 10, "nutrition": 30, "ingredients": 25, "allergens": 10}


def label_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per product: how much its label can be relied on, and the band of that."""
    c = F.col
    missing = R.issues(("servings", c("servings").isNull()), ("nutrition", c("energy").isNull()), ("ingredients", c("ingredients").isNull()), ("allergens", c("allergens") == 0))
    worth = F.create_map(*[F.lit(x) for pair in DEDUCTIONS.items() for x in pair])
    bonus = F.least(F.greatest(c("links") - 1, F.lit(0)) * 5, F.lit(5))
    sure = F.when(c("produce"), 100).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), 95 + bonus - F.aggregate(missing, F.lit(0), lambda a, x: a + worth[x]))))
    return goods(spark, sf_dir).withColumn("confidence", sure.cast("int")).select("id", "confidence", F.when(c("confidence") >= 95, "excellent").when(c("confidence") >= 80, "good").when(c("confidence") >= 60, "fair").otherwise("review").alias("band"))


def repair_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per product with a spoilt name: the rule that mends it, and its confidence."""
    c, k = F.col, F.col("id")
    g = goods(spark, sf_dir).withColumn("spoilt", F.when(k % 3 == 0, F.concat(F.lit(".,  "), "name")).when(k % 3 == 1, F.concat("name", F.lit(" .css-1x{color:red}"))).otherwise(F.concat("name", F.lit("  "), "name")))
    mended = F.trim(F.regexp_replace("spoilt", r"^[\s.,;:!?]+", ""))
    rule = F.when(c("spoilt").rlike(r"^[\s.,;:!?]+") & (mended == c("name")), F.struct(F.lit("remove-leading-punctuation").alias("rule"), F.lit(100).alias("confidence"))).when(c("spoilt").rlike("[{};]"), F.struct(F.lit("remove-css-or-markup-contamination").alias("rule"), F.lit(95).alias("confidence"))).otherwise(F.struct(F.lit("normalise-product-name").alias("rule"), F.lit(85).alias("confidence")))
    return g.select("id", rule.alias("r")).select("id", "r.rule", "r.confidence")


def needs_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products that need details: no number, and for what isn't a generic food, no image, category or brand."""
    c = F.col
    category = T.normalise(F.coalesce("stored", F.lit("")))
    generic = c("produce") | (c("brand").isNull() & c("gtin").isNull() & ((c("links") > 0) | category.rlike("produce|fruit|vegetable|fresh food")))
    wanted = c("gtin").isNull() & ~generic & (c("image").isNull() | c("stored").isNull() | c("brand").isNull())
    return goods(spark, sf_dir).filter(wanted).select("id")


def audit_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the catalogue's audit by kind, with their severity and number, the most severe first: conflicts of name and number, duplicates, images."""
    c = F.col
    g = goods(spark, sf_dir)
    twice = g.groupBy("brand", "name", "pack").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit("duplicate").alias("kind"))
    each = g.select(F.explode(R.issues(("no-image", c("image").isNull()), ("negative-energy", F.coalesce(c("energy") < 0, F.lit(False))), ("number-without-brand", c("gtin").isNotNull() & c("brand").isNull()))).alias("kind"))
    rank = F.when(c("kind") == "negative-energy", 0).when(c("kind").isin("duplicate", "number-without-brand"), 1).otherwise(2)
    return each.unionByName(twice).groupBy("kind").agg(F.count(F.lit(1)).alias("findings")).withColumn("severity", rank)


def merge_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposals for products of one identity (brand and name): the survivor is renamed unless its name is clean, the others are merged into it; without brand, reviewed."""
    c = F.col
    g = goods(spark, sf_dir).select("id", "name", "brand", "seen", F.concat_ws(" ", "brand", "name").alias("identity"), ((c("id") % 3 != 0).cast("int")).alias("score"))
    named = g.filter("brand is not null")
    # one row for each identity, joined back: an identity that many products have isn't sorted in one task
    first = named.groupBy("identity").agg(F.min_by("id", F.struct("score", "seen", "id")).alias("target"))
    kept = named.join(first, "identity")
    merges = kept.filter("id <> target").select("id", F.lit("MERGE").alias("action"), "target", F.lit(0.97).alias("confidence"))
    renames = kept.filter("id = target AND score > 0").select("id", F.lit("RENAME").alias("action"), F.lit(None).cast("long").alias("target"), F.lit(0.95).alias("confidence"))
    return merges.unionByName(renames).unionByName(g.filter("brand is null").select("id", F.lit("REVIEW").alias("action"), F.lit(None).cast("long").alias("target"), F.lit(0.3).alias("confidence")))


def fulfilment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of lists of ten products: lemon juice is bought as lemons, if lemons are on the same list."""
    items = goods(spark, sf_dir).select("id", F.expr("id div 10").alias("list"), "name", (F.col("id") % 300).cast("double").alias("quantity"), _pick(("ml", "l", "tbsp", "cup", "each"), F.col("id")).alias("unit"))
    has = items.filter("name = 'Lemons'").select("list").distinct()
    lemons = N.lemons_for_juice(F.when(F.col("quantity") > 0, F.col("quantity")).otherwise(1.0), F.col("unit"))
    juice = items.filter("name = 'Lemon Juice'").join(has, "list", "left_semi")
    return juice.select("id", F.lit("lemon").alias("bought"), F.greatest(F.lit(1), F.coalesce(lemons, F.ceil(F.greatest("quantity", F.lit(1.0))))).cast("long").alias("quantity"))


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue that names are resolved against: products whose key is a multiple of 7."""
    return goods(spark, sf_dir).filter("id % 7 = 0").select(F.col("id").alias("match"), "name", "brand", "gtin", F.concat_ws(" ", "brand", "name").alias("full"))


def resolved_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every listed name resolved: by number, by alias, by exact name, by its canonical name as alias or as name, else created; with confidence."""
    known = _known(spark, sf_dir)
    rows = listings(spark, sf_dir).select("id", "j", F.col("other_gtin").alias("by_gtin"), S.plain(F.col("other")).alias("by_alias"), F.lower("other").alias("by_name"), F.when(F.col("other") != "", S.plain(F.col("name"))).alias("by_family"))
    known = known.withColumns({"by_gtin": F.col("gtin"), "by_alias": S.plain(F.concat(F.col("full"), F.lit(" Value"))), "by_name": F.lower("full"), "by_family": F.when(F.col("brand").isNull(), S.plain(F.col("name")))})
    sure = {"gtin": 1.0, "alias": 0.98, "name": 0.95, "family": 0.97, "create": 0.5}
    found = R.cascade(rows, [(k, f"by_{k}", known.select(f"by_{k}", "match")) for k in ("gtin", "alias", "name", "family")], "match")
    return found.select("id", "j", "match", F.col("matched_by"), F.create_map(*[F.lit(x) for pair in sure.items() for x in pair])[F.col("matched_by")].alias("confidence"))


def filled_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every product against all keys of known ones (number, slug, full name) at once: the least match of the best kind, its gaps filled from the product."""
    known = _known(spark, sf_dir)
    of = lambda df, k: df.select(F.explode(F.array_compact(F.array(F.when(F.col("gtin").isNotNull(), F.struct(F.lit(1).alias("kind"), F.col("gtin").alias("key"))), F.struct(F.lit(2).alias("kind"), T.slug(F.col("full")).alias("key")), F.struct(F.lit(3).alias("kind"), F.lower("full").alias("key"))))).alias("k"), k).select("k.kind", "k.key", k)
    rows = goods(spark, sf_dir).select("id", "gtin", "pack", "brand", F.concat_ws(" ", "brand", "name").alias("full"))
    # each side grows with the catalogue, which its file's size doesn't tell: all are shuffled, none goes through the driver
    pairs = of(rows, "id").join(of(known, "match").groupBy("kind", "key").agg(F.min("match").alias("match")).hint("merge"), ["kind", "key"])
    best = pairs.groupBy("id").agg(F.min(F.struct("kind", "match")).alias("b"))
    joined = rows.join(best.hint("merge"), "id").join(known.select("match", F.col("gtin").alias("old_gtin")).hint("merge"), F.col("b.match") == F.col("match"))
    return joined.select("id", "match", F.col("b.kind").alias("kind"), F.coalesce("old_gtin", "gtin").alias("gtin"))


def preferred_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per name: the product that others should be merged into: exact name, then produce, then the oldest."""
    g = goods(spark, sf_dir).withColumn("listed", F.when(F.col("id") % 3 == 0, F.col("name")).otherwise(F.concat_ws(" ", "brand", "name")))
    order = [(F.lower("listed") == F.lower("name")).desc(), F.col("produce").desc(), F.col("seen"), F.col("id")]
    return R.top_rows(g, ["name"], order).select("name", "id")


def departments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per product name and stored category: the department, how items are counted, and the shopping category of the department."""
    rows = goods(spark, sf_dir).select("name", "stored").distinct()
    shelf = F.create_map(*[F.lit(x) for pair in SHELVES.items() for x in pair])
    return rows.select("name", "stored", M.department(F.col("name"), F.col("stored")).alias("department"), M.shape(F.lower("name")).alias("shape")).withColumn("shelf", F.coalesce(shelf[F.col("department")], F.lit("Pantry & other")))


# Shelves of a shopping list by department.
SHELVES = {"Fruit & vegetables": "Fruit & vegetables", "Bakery": "Bakery & grains", "Meat & seafood": "Meat & seafood", "Dairy & eggs": "Dairy & eggs", "Frozen": "Frozen", "Drinks": "Drinks", "Household": "Household"}


def product_search(spark: SparkSession, sf_dir: str, query: str = " MILK ", take: int = 500) -> DataFrame:
    """Products whose name, brand, number or alias holds the query, in any case; by name, 200 at most."""
    q = " ".join(query.split()).lower()
    alias = listings(spark, sf_dir).filter(F.lower("other").contains(q)).select("id").distinct().withColumn("hit", F.lit(True))
    g = goods(spark, sf_dir).join(alias, "id", "left")
    held = F.lower("name").contains(q) | F.coalesce(F.lower("brand").contains(q), F.lit(False)) | F.coalesce(F.col("gtin").contains(q), F.lit(False)) | F.coalesce("hit", F.lit(False))
    return g.filter(held).orderBy("name", "id").limit(min(max(take, 1), 200)).select("id", "name")


def stock_search(spark: SparkSession, sf_dir: str, query: str = "green apples") -> DataFrame:
    """Products whose text has every word of the query, or whose number is the query: what is in stock first, then the latest; fifty."""
    terms = query.lower().split()
    text = F.lower(F.concat_ws(" ", "brand", "name", "pack"))
    every = F.forall(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(text, t))
    return goods(spark, sf_dir).filter(every | F.coalesce(F.col("gtin") == query, F.lit(False))).orderBy((F.col("links") > 0).desc(), F.col("seen").desc(), "id").limit(50).select("id", "links", "seen")


def image_gallery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per product name, its three best images: chosen ones first, then by score, unknown scores last, then the newest."""
    c = F.col
    g = goods(spark, sf_dir).withColumns({"chosen": c("id") % 50 == 0, "score": F.when(c("id") % 6 != 0, c("id") * 31 % 101)})
    return R.top_rows(g, ["name"], [c("chosen").desc(), c("score").desc_nulls_last(), c("seen").desc(), c("id")], 3, "place").select("name", "place", "id", "score")


def family_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per family (a product's name): products, links, brand if all have the same, the price of the newest and whether one must choose a variant."""
    at = F.struct("seen", "id")
    g = goods(spark, sf_dir).groupBy("name").agg(F.countDistinct("id").alias("products"), F.sum("links").alias("links"), F.when(F.countDistinct(F.coalesce("brand", F.lit(""))) == 1, F.max("brand")).alias("brand"), F.max_by("price", at).alias("latest_price"), F.max_by("id", at).alias("latest_id"))
    return g.withColumn("choose", (F.col("products") > 1) & F.col("latest_price").isNotNull())


def relation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per product: how many lines, listings and suppliers refer to it, 0 where none does; each counted before it is joined."""
    line = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.count(F.lit(1)).alias("lines"), F.countDistinct("l_suppkey").alias("suppliers"))
    found = listings(spark, sf_dir).filter("external is not null").groupBy("id").agg(F.count(F.lit(1)).alias("listings"))
    zero = lambda x: F.coalesce(x, F.lit(0)).alias(x)
    return goods(spark, sf_dir).select("id").join(line, "id", "left").join(found, "id", "left").select("id", zero("lines"), zero("suppliers"), zero("listings"))


def sold_or_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products that have an image or a dear line: the join's second condition is on its right side, before the join."""
    dear = table(spark, sf_dir, "lineitem").filter("l_quantity >= 50 and l_discount < 0.01").select(F.col("l_partkey").alias("id")).distinct().withColumn("dear", F.lit(True))
    return goods(spark, sf_dir).join(dear, "id", "left").filter("image is not null or dear is not null").select("id", F.coalesce("dear", F.lit(False)).alias("dear"))


_FIT = f"""{LISTINGS_SQL}, fit AS (SELECT *, {_PLAIN.format("name")} AS x, {_PLAIN.format("other")} AS y, {_PLAIN.format("brand")} AS b, {_PLAIN.format("concat_ws(' ', brand, name)")} AS xb,
  {_pack_sql("pack")} AS p, {_pack_sql("other_pack")} AS q, {_pack_sql("coalesce(pack, name)")} AS lp, {_pack_sql("coalesce(other_pack, other)")} AS lq, gtin AS mine, other_gtin AS theirs FROM listings)"""
_NAMED = {name.lower().replace("&", "and"): name for name in V.DEPARTMENT_NAMES} | V.DEPARTMENT_ALIASES


def _department_sql(c: str) -> str:
    n = f"trim(regexp_replace(replace(lower({c}), '&', ' and '), '[^a-z0-9. ]+', ' ', 'g'))"
    named = " ".join(f"WHEN {n} = '{k}' THEN '{v}'" for k, v in _NAMED.items())
    ruled = " ".join(f"WHEN regexp_matches({n}, '\\b(?:{words})\\b') THEN '{name}'" for name, words in V.DEPARTMENT_RULES)
    return f"nullif(CASE {named} {ruled} END, 'Other')"


_ROW = "QUALIFY row_number() OVER (PARTITION BY {0} ORDER BY {1}) = 1"
_PCT = lambda *xs: "CAST(floor((" + " + ".join(f"CASE WHEN {x} THEN 1 ELSE 0 END" for x in xs) + f") * 100 / {len(xs)} + 0.5) AS INT)"
_SUB = f"""{GOODS_SQL}, s AS (SELECT *, CASE WHEN produce THEN {_PCT("true", "stored IS NOT NULL")} ELSE {_PCT("gtin IS NOT NULL", "true", "brand IS NOT NULL", "pack IS NOT NULL", "id % 2 = 0")} END AS identity,
  CASE WHEN produce THEN 100 ELSE {_PCT("servings IS NOT NULL", "energy IS NOT NULL")} END AS nutrition, CASE WHEN produce THEN 100 ELSE {_PCT("ingredients IS NOT NULL", "allergens > 0")} END AS label,
  CASE WHEN produce THEN 100 ELSE {_PCT("links > 0", "links > 1")} END AS retail, CASE WHEN produce OR image IS NOT NULL THEN 100 ELSE 0 END AS photo,
  list_filter(CASE WHEN produce THEN [CASE WHEN stored IS NULL THEN 'category' END] ELSE [CASE WHEN gtin IS NULL THEN 'gtin' END, CASE WHEN brand IS NULL THEN 'brand' END, CASE WHEN pack IS NULL THEN 'packSize' END, CASE WHEN servings IS NULL THEN 'servingsPerPackage' END, CASE WHEN energy IS NULL THEN 'energyPer100' END,
    CASE WHEN ingredients IS NULL THEN 'ingredients' END, CASE WHEN allergens = 0 THEN 'containsAllergens' END, CASE WHEN links = 0 THEN 'retailerListing' END, CASE WHEN image IS NULL THEN 'image' END] END, lambda x: x IS NOT NULL) AS missing FROM goods),
sub AS (SELECT *, CAST(floor(CASE WHEN produce THEN (identity * 3 + 700) / 10 ELSE (identity * 3 + nutrition * 3 + label * 2 + retail + photo) / 10 END + 0.5) AS INT) AS overall FROM s)"""

QUERIES = {
    "live_matches": (live_matches, f"""WITH {_FIT}, r AS (SELECT *, {_SHARE.format(_LONG.format("x"), "string_split(y, ' ')")} AS ratio, p IS NULL OR q IS NULL OR p = q AS same FROM fit),
s AS (SELECT *, CASE WHEN mine = theirs THEN 10000 WHEN mine <> theirs THEN NULL WHEN y = x THEN 1000 + CASE WHEN same THEN 80 ELSE 0 END WHEN contains(y, x) AND ratio >= 0.8 THEN 900 + ratio * 50 + CASE WHEN same THEN 50 ELSE -100 END
    WHEN ratio >= 0.75 AND same THEN 750 + ratio * 100 WHEN ratio >= 0.45 THEN 400 + ratio * 100 + CASE WHEN same THEN 30 ELSE -80 END END AS score,
  CASE WHEN mine = theirs OR y = x THEN true WHEN contains(y, x) AND ratio >= 0.8 THEN same WHEN ratio >= 0.75 AND same THEN true ELSE false END AS exact FROM r)
SELECT id, retailer, CAST(j AS INT) AS j, floor(score * 1000 + 0.5) / 1000 AS score, exact FROM s WHERE score IS NOT NULL {_ROW.format("id, retailer", "score DESC, offer, j")}"""),
    "accepted_listings": (accepted_listings, f"""WITH {_FIT}, s AS (SELECT *, CASE WHEN mine = theirs THEN 20000 WHEN mine <> theirs THEN NULL ELSE {_SHARE.format(_LONG.format("xb"), _LONG.format("y"))} * 1000 + CASE WHEN y = x THEN 1200 ELSE 0 END
    + CASE WHEN contains(regexp_replace(y, '[^a-z0-9]+', '', 'g'), regexp_replace(x, '[^a-z0-9]+', '', 'g')) THEN 700 ELSE 0 END + CASE WHEN b = '' THEN 0 WHEN contains(y, b) THEN 600 ELSE -700 END + CASE WHEN lp IS NULL OR lq IS NULL THEN 0 WHEN lp = lq THEN 900 ELSE -1200 END
    + CASE WHEN retailer = 'Coles' THEN 120 ELSE 0 END + CASE WHEN external IS NOT NULL THEN 80 ELSE 0 END + CASE WHEN image IS NOT NULL THEN 40 ELSE 0 END END AS score FROM fit),
t AS (SELECT * FROM s {_ROW.format("id, retailer", "score DESC NULLS LAST, j")})
SELECT id, retailer, CAST(j AS INT) AS j, floor(score * 1000 + 0.5) / 1000 AS score FROM t WHERE CASE WHEN gtin IS NOT NULL THEN coalesce(gtin = other_gtin, false) ELSE score >= 900 END"""),
    "barcode_candidates": (barcode_candidates, f"""WITH {_FIT}, s AS (SELECT id, j, floor(({_SHARE.format(_LONG.format("x"), "string_split(y, ' ')")} * 0.75 + CASE WHEN brand IS NULL OR contains(y, b) THEN 1.0 ELSE 0.0 END * 0.15
  + CASE WHEN pack IS NULL OR other_pack IS NULL OR {_PLAIN.format("pack")} = {_PLAIN.format("other_pack")} THEN 1.0 ELSE 0.0 END * 0.1) * 1e6 + 0.5) / 1e6 AS score FROM fit WHERE other_gtin IS NOT NULL)
SELECT id, CAST(j AS INT) AS j, CAST(score AS DOUBLE) AS score FROM s WHERE score >= 0.82 {_ROW.format("id", "score DESC, j")}"""),
    "external_products": (external_products, f"""WITH {LISTINGS_SQL}, s AS (SELECT *, CAST(60 + j * 3 + CASE WHEN brand IS NOT NULL THEN 8 ELSE 0 END + CASE WHEN image IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN other_pack IS NOT NULL THEN 8 ELSE 0 END + CASE WHEN stored IS NOT NULL THEN 4 ELSE 0 END
  + CASE WHEN ingredients IS NOT NULL THEN 5 ELSE 0 END + CASE WHEN energy IS NOT NULL THEN 8 ELSE 0 END + CASE WHEN regexp_matches(other, '(?i)[0-9]+ *(?:mg|g|kg|ml|l|capsules?|tablets?|pack|pk)') THEN 10 ELSE 0 END AS INT) AS score FROM listings),
l AS (SELECT *, lead(score) OVER w AS next, lead(external) OVER w AS e2 FROM s WINDOW w AS (PARTITION BY id ORDER BY score DESC, j) {_ROW.format("id", "score DESC, j")})
SELECT id, CAST(j AS INT) AS j, score, next IS NULL OR score - next >= 5 OR coalesce(external = e2, false) AS clear FROM l"""),
    "gtin_claims": (gtin_claims, f"""WITH {GOODS_SQL}, c AS (SELECT id, name, brand, pack, CASE WHEN id % 10 = 3 THEN '12345' WHEN id % 10 = 6 THEN '4006381333931' ELSE gtin END AS number, CASE WHEN id % 17 = 0 THEN 'Garden Hose' ELSE name END AS claimed,
  {_LIST(BRANDS)}[CAST((id + CASE WHEN id % 19 = 0 THEN 1 ELSE 0 END) % 4 AS INT) + 1] AS cb, CASE WHEN id % 4 <> 0 THEN pack END AS cp FROM goods), h AS (SELECT number, count(DISTINCT id) AS holders FROM c WHERE number IS NOT NULL AND number <> '12345' GROUP BY number)
SELECT id, c.number, CASE WHEN c.number = '12345' THEN 'INVALID' WHEN holders > 1 THEN 'REVIEW' WHEN claimed <> name OR (brand IS NOT NULL AND brand <> cb) OR (pack IS NOT NULL AND cp IS NOT NULL AND pack <> cp) THEN 'CONFLICT' WHEN id % 2 = 0 THEN 'VERIFIED' ELSE 'PROVISIONAL' END AS status
FROM c LEFT JOIN h ON c.number = h.number WHERE c.number IS NOT NULL"""),
    "misread_retailers": (misread_retailers, f"""WITH n AS (SELECT s_suppkey, s_name, {_LIST(RETAILERS)}[CAST(s_suppkey % {len(RETAILERS)} AS INT) + 1] AS n FROM supplier),
l AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN '** ' || upper(n[2:]) || ' 12' WHEN 1 THEN n || 'x' WHEN 2 THEN s_name || ' ' || upper(n) || ' stores' ELSE 'everyday ' || reverse(n) END AS line FROM n), t AS (SELECT *, regexp_replace(lower(line), '[^a-z]', '', 'g') AS w FROM l)
SELECT s_suppkey, line, CASE """ + " ".join(f"WHEN regexp_matches(line, '(?i){'|'.join(MARKERS[r])}') OR (length(w) BETWEEN {max(3, len(r) - misreadings(r)) if len(r) > 6 else len(r)} AND {len(r) + misreadings(r) if len(r) > 6 else len(r)} AND levenshtein(w, '{r}') <= {misreadings(r)}) THEN '{r}'" for r in RETAILERS) + " END AS retailer FROM t"),
    "image_scores": (image_scores, """WITH i AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 6 = 0 THEN 'text/html' WHEN p_partkey % 9 <> 0 THEN 'image/png' END AS kind, CASE WHEN p_partkey % 7 <> 0 THEN p_partkey * 37 % 90000 END AS size, CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_partkey * 13 % 1500 + 40 AS DOUBLE) END AS w, CASE WHEN p_partkey % 5 <> 1 THEN CAST(p_partkey * 29 % 1500 + 40 AS DOUBLE) END AS h FROM part),
d AS (SELECT *, least(w, h) AS short, greatest(w, h) AS long, w IS NOT NULL AND h IS NOT NULL AS known, coalesce(kind = 'image/png', false) AS image FROM i)
SELECT id, CASE WHEN id % 10 = 0 THEN 0 ELSE CAST(greatest(0, least(100, 45 + CASE WHEN image THEN 15 ELSE 0 END + CASE WHEN size >= 30000 THEN 10 ELSE 0 END + CASE WHEN known THEN CASE WHEN short >= 700 THEN 25 WHEN short >= 320 THEN 15 ELSE 0 END + CASE WHEN long / greatest(1, short) <= 1.6 THEN 5 ELSE 0 END ELSE 0 END
  - 12 * (CASE WHEN image THEN 0 ELSE 1 END + CASE WHEN size < 12000 THEN 1 ELSE 0 END + CASE WHEN known THEN CASE WHEN short < 320 THEN 1 ELSE 0 END + CASE WHEN long / greatest(1, short) > 3.2 THEN 1 ELSE 0 END ELSE 1 END))) AS INT) END AS score,
  CAST([32, 26, 15, 3, 5][CAST(id % 5 AS INT) + 1] + CASE WHEN known THEN CASE WHEN short >= 800 THEN 35 WHEN short >= 500 THEN 28 WHEN short >= 300 THEN 18 WHEN short >= 160 THEN 5 ELSE -25 END + CASE WHEN long / short <= 1.8 THEN 15 WHEN long / short <= 2.8 THEN 7 ELSE -12 END ELSE -8 END
  + CASE WHEN size >= 80000 THEN 12 WHEN size >= 25000 THEN 6 ELSE 0 END AS INT) AS sourced FROM d"""),
    "image_matches": (image_matches, f"""WITH {LISTINGS_SQL}, t AS (SELECT id, j, retailer = 'Coles' AS own, concat_ws(' ', brand, name, pack) AS a, other AS b FROM listings), w AS (SELECT *, {_TOKENS.format("a")} AS x, {_TOKENS.format("b")} AS y,
  regexp_extract(lower(a), '\\b(\\d{{1,3}})\\s*(?:pack|pk)\\b', 1) AS ca, regexp_extract(lower(b), '\\b(\\d{{1,3}})\\s*(?:pack|pk)\\b', 1) AS cb, regexp_extract(lower(a), '\\b(\\d+)\\s*(ml|l|g|kg)\\b', 1) AS na, regexp_extract(lower(a), '\\b(\\d+)\\s*(ml|l|g|kg)\\b', 2) AS ua,
  regexp_extract(lower(b), '\\b(\\d+)\\s*(ml|l|g|kg)\\b', 1) AS nb, regexp_extract(lower(b), '\\b(\\d+)\\s*(ml|l|g|kg)\\b', 2) AS ub FROM t),
v AS (SELECT *, len(list_intersect(x, y)) / len(x) AS cov, len(list_intersect(x, y)) / len(y) AS pre, try_cast(na AS INT) * CASE WHEN ua IN ('l', 'kg') THEN 1000 ELSE 1 END AS sa, try_cast(nb AS INT) * CASE WHEN ub IN ('l', 'kg') THEN 1000 ELSE 1 END AS sb, ua IN ('l', 'ml') AS va, ub IN ('l', 'ml') AS vb FROM w)
SELECT id, CAST(j AS INT) AS j, CAST(CASE WHEN cov >= 0.75 THEN floor(60 * cov + 25 * pre + CASE WHEN own THEN 12 ELSE 5 END + 0.5) ELSE 0 END AS INT) AS produce,
  CAST(CASE WHEN cov < 0.72 OR (ca <> '' AND cb <> '' AND ca <> cb) OR (na <> '' AND nb <> '' AND (va <> vb OR sa <> sb)) THEN 0 ELSE least(99, floor(68 * cov + 0.5) + CASE WHEN ca <> '' AND ca = cb THEN 14 ELSE 0 END + CASE WHEN na <> '' AND nb <> '' AND sa = sb AND va = vb THEN 12 ELSE 0 END + CASE WHEN own THEN 8 ELSE 0 END) END AS INT) AS packaged FROM v"""),
    "sub_scores": (sub_scores, f"WITH {_SUB} SELECT id, identity, nutrition, label, retail, photo, overall, array_to_string(missing, ',') AS missing FROM sub"),
    "repair_queue": (repair_queue, f"WITH {_SUB}, m AS (SELECT id, unnest(missing) AS f, 100 - least(80, overall) AS priority FROM sub) SELECT id, 'MISSING_' || upper(regexp_replace(f, '([a-z])([A-Z])', '\\1_\\2', 'g')) AS reason, priority FROM m ORDER BY priority DESC, id, reason LIMIT 100"),
    "review_filters": (review_filters, f"WITH {_SUB} SELECT 'identity' AS filter, count(*) AS products FROM sub WHERE identity < 100 UNION ALL SELECT 'nutrition', count(*) FROM sub WHERE nutrition < 100 UNION ALL SELECT 'label', count(*) FROM sub WHERE label < 100 UNION ALL SELECT 'retail', count(*) FROM sub WHERE retail < 100 UNION ALL SELECT 'image', count(*) FROM sub WHERE photo < 100 UNION ALL SELECT 'review', count(*) FROM sub WHERE len(missing) > 0"),
    "catalogue_lint": (catalogue_lint, f"""WITH {GOODS_SQL}, l AS (SELECT *, CASE id % 4 WHEN 0 THEN concat_ws(' ', brand, name, pack) WHEN 1 THEN 'WW ' || lower(name) ELSE name END AS listed FROM goods),
i AS (SELECT id, list_filter([CASE WHEN regexp_matches(listed, '(?i)\\b(?:coles|woolworths|aldi|costco)\\b') THEN 'RETAILER_IN_NAME' END, CASE WHEN regexp_matches(listed, '(?i)\\b[0-9]+(?:\\.[0-9]+)? *(?:kg|g|ml|l)\\b') THEN 'PACK_SIZE_IN_NAME' END, CASE WHEN regexp_matches(listed, '(?i)\\b(?:ww|slcd|pk)\\b') THEN 'RECEIPT_ABBREVIATION' END,
  CASE WHEN image LIKE '%9' THEN 'SUSPICIOUS_IMAGE' END, CASE WHEN image IS NULL THEN 'MISSING_IMAGE' END], lambda x: x IS NOT NULL) AS issues FROM l)
SELECT id, array_to_string(issues, ',') AS issues, CAST(greatest(0, 100 - coalesce(list_sum(list_transform(issues, lambda x: CASE x WHEN 'SUSPICIOUS_IMAGE' THEN 35 WHEN 'MISSING_IMAGE' THEN 5 ELSE 15 END)), 0)) AS INT) AS score FROM i"""),
    "label_confidence": (label_confidence, f"""WITH {GOODS_SQL}, c AS (SELECT id, CAST(CASE WHEN produce THEN 100 ELSE greatest(0, least(100, 95 + least(greatest(links - 1, 0) * 5, 5) - CASE WHEN servings IS NULL THEN 10 ELSE 0 END - CASE WHEN energy IS NULL THEN 30 ELSE 0 END - CASE WHEN ingredients IS NULL THEN 25 ELSE 0 END - CASE WHEN allergens = 0 THEN 10 ELSE 0 END)) END AS INT) AS confidence FROM goods)
SELECT *, CASE WHEN confidence >= 95 THEN 'excellent' WHEN confidence >= 80 THEN 'good' WHEN confidence >= 60 THEN 'fair' ELSE 'review' END AS band FROM c"""),
    "repair_rules": (repair_rules, f"WITH {GOODS_SQL} SELECT id, CASE id % 3 WHEN 0 THEN 'remove-leading-punctuation' WHEN 1 THEN 'remove-css-or-markup-contamination' ELSE 'normalise-product-name' END AS rule, CASE id % 3 WHEN 0 THEN 100 WHEN 1 THEN 95 ELSE 85 END AS confidence FROM goods"),
    "needs_details": (needs_details, f"WITH {GOODS_SQL} SELECT id FROM goods WHERE gtin IS NULL AND NOT (produce OR (brand IS NULL AND (links > 0 OR stored = 'Fresh produce'))) IS TRUE AND (image IS NULL OR stored IS NULL OR brand IS NULL)"),
    "audit_findings": (audit_findings, f"""WITH {GOODS_SQL} SELECT 'negative-energy' AS kind, count(*) AS findings, 0 AS severity FROM goods WHERE energy < 0 HAVING count(*) > 0 UNION ALL SELECT 'number-without-brand', count(*), 1 FROM goods WHERE gtin IS NOT NULL AND brand IS NULL HAVING count(*) > 0
UNION ALL SELECT 'no-image', count(*), 2 FROM goods WHERE image IS NULL HAVING count(*) > 0 UNION ALL SELECT 'duplicate', count(*), 1 FROM (SELECT 1 FROM goods GROUP BY brand, name, pack HAVING count(*) > 1) HAVING count(*) > 0"""),
    "merge_proposals": (merge_proposals, f"""WITH {GOODS_SQL}, k AS (SELECT id, CASE WHEN id % 3 <> 0 THEN 1 ELSE 0 END AS score, row_number() OVER w AS r, first_value(id) OVER w AS target FROM goods WHERE brand IS NOT NULL WINDOW w AS (PARTITION BY brand, name ORDER BY CASE WHEN id % 3 <> 0 THEN 1 ELSE 0 END, seen, id))
SELECT id, 'MERGE' AS action, target, 0.97::DOUBLE AS confidence FROM k WHERE r > 1 UNION ALL SELECT id, 'RENAME', NULL, 0.95 FROM k WHERE r = 1 AND score > 0 UNION ALL SELECT id, 'REVIEW', NULL, 0.3 FROM goods WHERE brand IS NULL"""),
    "fulfilment": (fulfilment, f"""WITH {GOODS_SQL}, i AS (SELECT id, id // 10 AS l, name, greatest(CAST(id % 300 AS DOUBLE), 1) AS q, ['ml', 'l', 'tbsp', 'cup', 'each'][CAST(id % 5 AS INT) + 1] AS unit FROM goods)
SELECT id, 'lemon' AS bought, CAST(greatest(1, CASE unit WHEN 'ml' THEN ceil(q / 45) WHEN 'l' THEN ceil(q * 1000 / 45) WHEN 'tbsp' THEN ceil(q * 15 / 45) WHEN 'cup' THEN ceil(q * 250 / 45) ELSE ceil(q) END) AS BIGINT) AS quantity FROM i WHERE name = 'Lemon Juice' AND l IN (SELECT l FROM i WHERE name = 'Lemons')"""),
    "resolved_products": (resolved_products, f"""WITH {LISTINGS_SQL}, k AS (SELECT id AS match, name, brand, gtin, concat_ws(' ', brand, name) AS title FROM goods WHERE id % 7 = 0), r AS (SELECT id, j, other, other_gtin, name FROM listings),
g AS (SELECT gtin, min(match) AS m FROM k WHERE gtin IS NOT NULL GROUP BY 1), a AS (SELECT {_PLAIN.format("title || ' Value'")} AS x, min(match) AS m FROM k GROUP BY 1), n AS (SELECT lower(title) AS x, min(match) AS m FROM k GROUP BY 1), f AS (SELECT {_PLAIN.format("name")} AS x, min(match) AS m FROM k WHERE brand IS NULL GROUP BY 1),
z AS (SELECT r.id, r.j, g.m AS m1, a.m AS m2, n.m AS m3, f.m AS m4 FROM r LEFT JOIN g ON r.other_gtin = g.gtin LEFT JOIN a ON {_PLAIN.format("r.other")} = a.x LEFT JOIN n ON lower(r.other) = n.x LEFT JOIN f ON {_PLAIN.format("r.name")} = f.x)
SELECT id, CAST(j AS INT) AS j, coalesce(m1, m2, m3, m4) AS match, CASE WHEN m1 IS NOT NULL THEN 'gtin' WHEN m2 IS NOT NULL THEN 'alias' WHEN m3 IS NOT NULL THEN 'name' WHEN m4 IS NOT NULL THEN 'family' ELSE 'create' END AS matched_by,
  CAST(CASE WHEN m1 IS NOT NULL THEN 1.0 WHEN m2 IS NOT NULL THEN 0.98 WHEN m3 IS NOT NULL THEN 0.95 WHEN m4 IS NOT NULL THEN 0.97 ELSE 0.5 END AS DOUBLE) AS confidence FROM z"""),
    "filled_products": (filled_products, f"""WITH {GOODS_SQL}, k AS (SELECT id AS match, gtin, concat_ws(' ', brand, name) AS title FROM goods WHERE id % 7 = 0), r AS (SELECT id, gtin, concat_ws(' ', brand, name) AS title FROM goods),
p AS (SELECT r.id, 1 AS kind, min(k.match) AS match FROM r JOIN k ON r.gtin = k.gtin GROUP BY r.id UNION ALL SELECT r.id, 2, min(k.match) FROM r JOIN k ON r.title = k.title GROUP BY r.id), b AS (SELECT * FROM p {_ROW.format("id", "kind, match")})
SELECT b.id, b.match, b.kind, coalesce(k.gtin, r.gtin) AS gtin FROM b JOIN r USING (id) JOIN k ON b.match = k.match"""),
    "preferred_targets": (preferred_targets, f"WITH {GOODS_SQL} SELECT name, id FROM goods {_ROW.format('name', 'CASE WHEN id % 3 = 0 OR brand IS NULL THEN 0 ELSE 1 END, produce DESC, seen, id')}"),
    "departments": (departments, f"WITH {GOODS_SQL}, d AS (SELECT DISTINCT name, stored FROM goods), e AS (SELECT *, coalesce({_department_sql('name')}, {_department_sql('stored')}, 'Other') AS department FROM d) SELECT *, CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(name), '{w}')" for w in listed) + f" THEN '{shape}'" for shape, listed in V.SHAPES) + " ELSE 'UNKNOWN' END AS shape, CASE department " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SHELVES.items()) + " ELSE 'Pantry & other' END AS shelf FROM e"),
    "product_search": (product_search, f"WITH {LISTINGS_SQL} SELECT id, name FROM goods g WHERE name ILIKE '%milk%' OR brand ILIKE '%milk%' OR gtin LIKE '%milk%' OR EXISTS (SELECT 1 FROM listings l WHERE l.id = g.id AND l.other ILIKE '%milk%') ORDER BY name, id LIMIT 200"),
    "stock_search": (stock_search, f"WITH {GOODS_SQL} SELECT id, links, seen FROM goods WHERE lower(concat_ws(' ', brand, name, pack)) LIKE '%green%' AND lower(concat_ws(' ', brand, name, pack)) LIKE '%apples%' ORDER BY links > 0 DESC, seen DESC, id LIMIT 50"),
    "image_gallery": (image_gallery, f"WITH {GOODS_SQL}, r AS (SELECT name, id, CASE WHEN id % 6 <> 0 THEN id * 31 % 101 END AS score, seen FROM goods), p AS (SELECT name, CAST(row_number() OVER (PARTITION BY name ORDER BY id % 50 = 0 DESC, score DESC NULLS LAST, seen DESC, id) AS INT) AS place, id, score FROM r) SELECT * FROM p WHERE place <= 3"),
    "family_rollup": (family_rollup, f"WITH {GOODS_SQL} SELECT name, count(*) AS products, CAST(sum(links) AS BIGINT) AS links, CASE WHEN count(DISTINCT coalesce(brand, '')) = 1 THEN max(brand) END AS brand, arg_max(price, (seen, id)) AS latest_price, arg_max(id, (seen, id)) AS latest_id, count(*) > 1 AS choose FROM goods GROUP BY name"),
    "relation_counts": (relation_counts, f"WITH {LISTINGS_SQL} SELECT g.id, (SELECT count(*) FROM lineitem WHERE l_partkey = g.id) AS lines, (SELECT count(DISTINCT l_suppkey) FROM lineitem WHERE l_partkey = g.id) AS suppliers, (SELECT count(external) FROM listings l WHERE l.id = g.id) AS listings FROM goods g"),
    "sold_or_listed": (sold_or_listed, f"WITH {GOODS_SQL}, d AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_quantity >= 50 AND l_discount < 0.01) SELECT g.id, d.id IS NOT NULL AS dear FROM goods g LEFT JOIN d ON g.id = d.id WHERE image IS NOT NULL OR d.id IS NOT NULL"),
}
