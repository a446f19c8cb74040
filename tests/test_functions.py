from pyspark.sql import functions as F

from basketry.functions import names as M
from basketry.functions import numbers as N
from basketry.functions import text as T
from basketry.operators import relational as R


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_money_rounds_half_up(spark):
    assert tuple(one(spark, N.round_money(F.lit(1.005)), N.round_half_up(F.lit(-2.5)))) == (1.01, -2.0)


def test_comparable_price(spark):
    def price(p, q, u):
        return tuple(one(spark, N.comparable_price(F.lit(p), F.lit(q), F.lit(u)).alias("x"))["x"])

    assert price(12.0, 2.0, "kg") == (0.6, "per 100 g")
    assert price(3.0, 750.0, "ml") == (4.0, "per L")
    assert price(6.0, 0.0, "items") == (6.0, "per item")


def test_gtin(spark):
    assert tuple(one(spark, N.gtin_valid(F.lit("9300605119413")), N.gtin_valid(F.lit("4006381333931")), N.gtin_valid(F.lit("4006381333932")), N.gtin_valid(F.lit(""))))[1:] == (True, False, False)


def test_names(spark):
    got = one(spark, M.corrected(F.lit("Coles Diced Courgettes 2 kg")), T.match_score(F.lit("Red apples"), F.lit("apple red")), T.normalise(F.lit("Mac & Cheese's -  2.5")))
    assert tuple(got) == ("Coles Diced zucchini 2 kg", 80, "mac and cheeses 2.5")


def test_dates_and_quantities(spark):
    got = one(spark, N.iso_minutes(F.lit("PT1H30M")), N.day_first_date(F.lit("x 31/02/2024 1/3/24")).cast("string"), N.parse_fraction(F.lit("1 1/2")), N.backoff_seconds(F.lit(3)), N.pack_size(F.lit("beans 2 x 400 g"))["quantity"])
    assert tuple(got) == (90, "2024-03-01", 1.5, 60, 800.0)


def test_best_match_finds_all_that_score(spark):
    names = ["red apple", "apple", "app", "green apple pie", "pear", "ab", "a", "big red apple tart", "pears", ""]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = {(r.n, r.m, r.score) for r in R.best_match(df, df.withColumnRenamed("n", "m"), "n", "m", T.match_score).collect()}
    pairs = df.crossJoin(df.withColumnRenamed("n", "m")).withColumn("score", T.match_score(F.col("n"), F.col("m"))).filter("score > 0")
    assert got == {(r.n, r.m, r.score) for r in pairs.collect()}


def test_upsert_keeps_old_where_new_is_unknown(spark):
    old = spark.createDataFrame([(1, "a", ["x"]), (2, "b", [])], "k int, v string, t array<string>")
    new = spark.createDataFrame([(1, None, []), (3, "c", ["y"])], "k int, v string, t array<string>")
    assert sorted(map(tuple, R.upsert(old, new, "k").collect())) == [(1, "a", ["x"]), (2, "b", []), (3, "c", ["y"])]


def test_prices_round_as_binary_numbers_do(spark):
    import random

    from basketry.functions import numbers as N

    r = random.Random(6)
    texts = ["1.005", "2.675", "0.125", "0.375", "1.115", "0.001", "0.005", "$1,234.565 ea", "99999999.995", "1e3", "0", "a", "1.2.3", "8.5", "0.994999999"] + [f"{r.randint(0, 10**r.randint(1, 7))}.{r.randint(0, 999):03d}" for _ in range(2000)]
    digits = ["".join(x for x in t if x.isdigit() or x == ".") for t in texts]

    def told(x):
        try:
            return round(float(x), 2) if float(x) > 0 else None
        except ValueError:
            return None

    got = [x[0] for x in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(N.parse_price(F.col("t"))).collect()]
    assert got == [told(x) for x in digits]


def test_retailers_by_mark_or_misread(spark):
    from basketry.functions.receipts import line_role
    from basketry.functions.retailers import names_retailer, retailer_of

    rows = [("Colgg", "coles"), ("Woolwrths", "woolworths"), ("COLA", None), ("ALDI STORES", "aldi"), ("IGA X-PRESS", "iga"), ("drakes", "drakes"), ("x\ncostca", "costco"), ("ABN 45 004 189 708", "coles"), ("the fresh food people", "woolworths"), ("", None)]
    df = spark.createDataFrame(rows, "t string, told string")
    assert all(x.told == x.r for x in df.withColumn("r", retailer_of(F.col("t"))).collect())
    assert df.filter("t = 'COLA'").select(names_retailer(F.col("t"), "coles")).first()[0] is False
    lines = [("ALDI STORES", "header"), ("IGA X-PRESS", "header"), ("ALDI 2.00", "product"), ("Descr1ption", "header"), ("hello", "unknown")]
    assert all(x.told == x.r for x in spark.createDataFrame(lines, "t string, told string").withColumn("r", line_role(F.col("t"))).collect())


def test_sections_of_ingredients(spark):
    from basketry.functions import labels as L

    rows = [(1, ["Nutrition Information", "Ingredients", "Sugar, milk,", "wheat flour, salt", "Allergens", "Contains: Milk"]), (2, ["Ingredients: water, sugar, salt", "Ingredients", "milk powder, flour"]), (3, ["Ingredients", "Contains: Milk"]), (4, ["Serving size: 5 g", "ingredient", "Cocoa, sugar, milk"])]
    got = {r.k: r.label.ingredients if r.label else None for r in L.with_label(spark.createDataFrame(rows, "k int, lines array<string>"), "lines").collect()}
    assert got == {1: "Sugar, milk, wheat flour, salt", 2: "water, sugar, salt", 3: None, 4: "Cocoa, sugar, milk"}
