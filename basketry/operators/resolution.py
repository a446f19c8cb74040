"""Resolution of a batch of names to products, as if row after row: what an earlier row creates or calls a product, a later one finds.

Each row depends on earlier ones only, so what rows do is found in rounds over whole tables: rows whose reasons are settled settle others.  Only a
count comes to the driver after a round.  Then every row points to a known product, to itself, or to the earlier row that it follows, and pointers are
doubled until all point to an end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.operators.relational import top_rows
from basketry.operators.sequence import last_before

Write = Callable[[DataFrame], DataFrame]
#: Confidence of each way to find a product.
SURE = {"barcode": 1.0, "alias": 0.98, "exact-name": 0.95, "canonical-alias": 0.97, "canonical": 0.95}


def _earliest(rows: DataFrame, key: str, as_: str) -> DataFrame:
    """Per value of a key the first row that has it."""
    return rows.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("__k")).agg(F.min("at").alias(as_))


def _with(rows: DataFrame, key: str, found: DataFrame) -> DataFrame:
    return rows.join(found, F.col(key) == F.col("__k"), "left").drop("__k")


def resolve(batch: DataFrame, products: DataFrame, aliases: DataFrame, write: Write, most: int = 100, blocks: int = 1) -> tuple[DataFrame, DataFrame]:
    """Rows of a batch resolved, and the aliases that hold afterwards.

    batch: at (a whole number, unique: the order), name, normalised, canonical (its canonical name), canonical_normalised, barcode, fresh (confidence if it is created without barcode).
    products: id (long, not negative), name, canonical, barcode, confidence, updated, created.  aliases: normalised (unique), product.

    A row is found by its barcode; else by an alias of its name; else by the very name, in any case, the one last updated; else by an alias of its canonical name;
    else by a canonical or other name equal to that, the surest and oldest; else it creates a product, -1 - at.  What is found otherwise than by
    alias gets the name as alias, in place of what had it; what is found by canonical name or created also gets that one.  Of equal products the least id counts.  Rows
    without a normalised name are left out.  write cuts the lineage (a table or checkpoint).

    Returns at, product, reason, confidence; and normalised, product, at (of the row that wrote it, null for those that were there).
    """
    c = F.col
    named = batch.filter("normalised <> ''").withColumns({"lower_name": F.lower("name"), "lower_canonical": F.lower("canonical")})
    pick = lambda df, key, order: top_rows(df.filter(F.col(key).isNotNull()), [key], order)
    by_code = products.filter("barcode is not null").groupBy(c("barcode").alias("__k")).agg(F.min("id").alias("db_code"))
    by_name = pick(products.withColumn("__k", F.lower("name")), "__k", [c("updated").desc_nulls_last(), c("id")]).select("__k", c("id").alias("db_name"))
    called = products.select("id", "confidence", "created", F.explode(F.array_distinct(F.array(F.lower("name"), F.lower("canonical")))).alias("__k"))
    by_canonical = pick(called, "__k", [c("confidence").desc_nulls_last(), c("created").asc_nulls_last(), c("id")]).select("__k", c("id").alias("db_canonical"))
    known = lambda out: aliases.filter("normalised is not null").groupBy(c("normalised").alias("__k")).agg(F.min("product").alias(out))
    rows = _with(_with(_with(named, "barcode", by_code), "lower_name", by_name), "lower_canonical", by_canonical)
    rows = _with(_with(rows, "normalised", known("db_alias")), "canonical_normalised", known("db_canonical_alias"))
    # the first row of a name, and the first that is named as this one is called canonically
    rows = _with(_with(rows, "normalised", _earliest(named, "normalised", "first")), "canonical_normalised", _earliest(named, "normalised", "first_named"))
    rows = write(rows.withColumns({"deep": F.lit(False), "creates": F.lit(False)}))
    settled = False
    for _ in range(most):
        # the first row of each canonical name that got so far, and of each barcode that creates
        deep = _earliest(rows.filter("deep"), "canonical_normalised", "first_deep")
        reach = _with(_with(rows, "normalised", deep.withColumnRenamed("first_deep", "deep_name")), "canonical_normalised", deep.withColumnRenamed("first_deep", "deep_canonical"))
        reach = _with(reach, "barcode", _earliest(rows.filter("creates"), "barcode", "first_code"))
        before = lambda x: F.coalesce(c(x) < c("at"), F.lit(False))
        hit = c("db_code").isNotNull() | before("first_code")
        alias = c("db_alias").isNotNull() | before("first") | before("deep_name")
        exact = c("db_name").isNotNull()
        canonical_alias = c("db_canonical_alias").isNotNull() | before("first_named") | before("deep_canonical")
        reason = F.when(hit, "barcode").when(alias, "alias").when(exact, "exact-name").when(canonical_alias, "canonical-alias").when(c("db_canonical").isNotNull(), "canonical").otherwise("created")
        reach = reach.withColumn("reason", reason).withColumns({"deep_now": c("reason").isin("canonical-alias", "canonical", "created"), "creates_now": c("reason") == "created"})
        reach = write(reach.withColumn("moved", (c("deep") != c("deep_now")) | (c("creates") != c("creates_now"))))
        rows = reach.withColumns({"deep": c("deep_now"), "creates": c("creates_now")}).drop("deep_now", "creates_now", "deep_name", "deep_canonical", "reason", "moved")
        if reach.filter("moved").isEmpty():
            settled = True
            break
        rows = rows.drop("first_code")
    if not settled:
        raise RuntimeError(f"rows still change after {most} rounds")
    rows = reach
    # who wrote the alias that a row goes by: rows found otherwise write their name, those found by canonical name or created that one too
    both = F.array(F.when(c("reason") != "alias", c("normalised")), F.when(c("reason").isin("canonical", "created"), c("canonical_normalised")))
    writes = rows.select("at", F.explode(F.array_distinct(F.array_compact(both))).alias("k"), F.lit(True).alias("writes"))
    asks = rows.filter(c("reason").isin("alias", "canonical-alias")).select("at", F.when(c("reason") == "alias", c("normalised")).otherwise(c("canonical_normalised")).alias("k"), F.lit(False).alias("writes"))
    events = last_before(writes.unionByName(asks), "k", "at", F.when(c("writes"), c("at")), "by", blocks)
    follows = events.filter("not writes").select("at", c("by").alias("follows"))
    start = rows.join(follows, "at", "left")
    own = F.when(c("reason") == "created", -1 - c("at")).when(c("reason") == "exact-name", c("db_name")).when(c("reason") == "canonical", c("db_canonical"))
    own = own.when((c("reason") == "barcode") & c("db_code").isNotNull(), c("db_code")).when((c("reason") == "alias") & c("follows").isNull(), c("db_alias")).when((c("reason") == "canonical-alias") & c("follows").isNull(), c("db_canonical_alias"))
    ways = write(start.select("at", "reason", "barcode", "fresh", own.alias("product"), F.when(own.isNull(), F.when(c("reason") == "barcode", c("first_code")).otherwise(c("follows"))).alias("next")))
    while not (open_ := ways.filter("product is null")).isEmpty():
        ahead = ways.select(c("at").alias("next"), c("product").alias("__product"), c("next").alias("__next"))
        stepped = open_.drop("product").join(ahead, "next").select("at", "reason", "barcode", "fresh", c("__product").alias("product"), c("__next").alias("next"))
        ways = write(ways.filter("product is not null").unionByName(stepped))
    sure = F.create_map(*[F.lit(x) for pair in SURE.items() for x in pair])[c("reason")]
    said = F.when(c("reason") == "created", F.when(c("barcode").isNotNull(), 0.75).otherwise(c("fresh"))).otherwise(sure)
    found = ways.select("at", "product", "reason", said.alias("confidence"))
    last = writes.groupBy("k").agg(F.max("at").alias("at")).join(ways.select("at", "product"), "at").select(c("k").alias("normalised"), "product", "at")
    kept = aliases.select("normalised", "product", F.lit(None).cast("long").alias("at")).join(last, "normalised", "left_anti")
    return found, kept.unionByName(last)


def filled(batch: DataFrame, products: DataFrame, found: DataFrame, columns: list[str]) -> DataFrame:
    """The products as the batch leaves them: those of the table and those that were created, each gap of a column filled by the first row that was resolved to it and has
    a value.  products has id and the columns, batch has at and the columns, found at and product."""
    rows = found.join(batch.select("at", *columns), "at")
    given = rows.groupBy(F.col("product").alias("id")).agg(*[F.min(F.when(F.col(x).isNotNull(), F.struct("at", x)))[x].alias(f"__{x}") for x in columns])
    return products.select("id", *columns).join(given, "id", "full_outer").select("id", *[F.coalesce(x, f"__{x}").alias(x) for x in columns])
