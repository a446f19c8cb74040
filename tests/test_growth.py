"""What keeps the work of a row and the shuffle of a step small: each would fail on the code before it was mended."""

from pyspark.sql import functions as F

from basketry.functions import labels as L
from basketry.functions import numbers as N
from basketry.functions import scores as S

DATA = "/root/testdata/sf0.001"


def test_a_label_is_read_once_for_its_headings(spark):
    df = L.with_label(spark.createDataFrame([(1, ["Nutrition information", "Energy: 5 kJ"])], "k int, lines array<string>"), "lines")
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("[–—]") == 1
    assert df.first().label.nutrients.energy.per_100 == 5


def test_scores_normalise_each_name_once(spark):
    c = F.col
    rows = spark.createDataFrame([("milk", "coles", "2 L", None, "coles milk 2 L", None, None)], "n string, b string, p string, g string, o string, q string, h string")
    live = rows.select(S.live_score(c("n"), c("b"), c("p"), c("g"), c("o"), c("q"), c("h"), True).alias("s"))
    sure = rows.select(S.listing_score(c("n"), c("b"), c("p"), c("g"), c("o"), c("q"), c("h"), F.lit(0)).alias("s"))
    for df, most in ((live, 5), (sure, 6)):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("&,  and ") <= most
    # all words, the name held by the other, the brand and the pack
    assert live.first().s.exact and sure.first().s == 1000 + 700 + 600 + 900


def test_a_price_is_parsed_once(spark):
    df = spark.createDataFrame([("$2.675",)], "x string").select(N.parse_price(F.col("x")).alias("p"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("[^0-9.]") == 1
    assert df.first().p == 2.67


def test_costly_rows_of_a_small_table_are_dealt_over_all_cores(spark):
    from basketry.plans import queries

    for name in ("label_values", "said_amounts"):
        assert queries()[name][0](spark, DATA).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_changes_of_small_keys_are_written_nowhere(spark):
    import random

    from basketry.operators.durable import cut
    from basketry.operators.versions import guarded

    r = random.Random(3)
    rows = [(r.choice(["p", "p", "p", "q", None]), at, *((None, None, r.randrange(at)) if at and r.random() < 0.4 else (r.choice(["a", "b", None]), r.choice("ab"), None))) for at in range(80)]
    changes = spark.createDataFrame(rows, "key string, at long, expected string, value string, undoes long").repartition(3)
    states = spark.createDataFrame([("p", "a"), ("q", "b")], "key string, value string")
    told = lambda df: sorted(map(str, df.select("at", "previous", "next", "accepted").collect()))
    got = told(guarded(changes, states, None))
    # q by itself or both by pointers: the same
    assert got == told(guarded(changes, states, cut, replayed=30)) == told(guarded(changes, states, cut, replayed=0)) and any("accepted=True" in x for x in got)


def test_baskets_are_at_each_supplier(spark):
    from basketry.plans import prices

    shops = {r.s_name for r in spark.read.parquet(f"{DATA}/supplier.parquet").collect()}
    for query in (prices.basket, prices.basket_all):
        got = {r.retailer for r in query(spark, DATA).select("retailer").distinct().collect()}
        assert got and got <= shops


def test_phrases_are_sent_and_not_the_runs_of_words(spark):
    from basketry.operators.relational import contained_phrases
    from basketry.plans import queries

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    small = plan(queries()["longest_concepts"][0](spark, DATA))
    assert "Inner, BuildRight" in small and "Inner, BuildLeft" not in small
    # phrases of more than 4 MB are shuffled
    many = spark.range(200_000).selectExpr("concat('word ', id) phrase", "cast(id as int) rank")
    rows = spark.createDataFrame([(1, "a word 7 word 12345 word")], "id int, text string")
    found = contained_phrases(rows, "id", "text", many)
    assert "BroadcastHashJoin" not in plan(found) and found.first().phrase == "word 12345"


def test_filling_sends_nothing_to_the_driver(spark):
    from basketry.plans import queries

    assert "Broadcast" not in queries()["filled_products"][0](spark, DATA)._jdf.queryExecution().executedPlan().toString()


def test_recognised_products_take_words_from_texts_once(spark):
    from basketry.plans import queries

    plan = queries()["recognised_products"][0](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "levenshtein" not in plan


def test_regions_read_and_deal_their_lines_once(spark):
    from basketry.plans import queries

    plan = queries()["receipt_regions"][0](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    # no join but that of the order lines with the products
    assert plan.count("Join ") == 1


def test_words_with_pairs_of_letters_that_come_again_meet(spark):
    from basketry.operators.fuzzy import alike_words

    told = [("rrrr", "rarr"), ("ieie", "geie"), ("vioi", "oioi"), ("ingonon", "ononon"), ("eanonan", "ananan"), ("tzte", "tete")]
    words = spark.createDataFrame(told, "a string, b string")
    found = {(x.a, x.b) for x in alike_words(words.select("a"), words.select("b"), 0.69).collect()}
    assert set(told) <= found


def test_a_description_is_cleaned_where_it_stands_and_carried(spark):
    from basketry.functions import parsing as P

    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(("Description $", "Tea bags", "2.50", "3 x Oat milk", "Qty 2 @ $1.25 each", "Rice 4.00", "TOTAL 9.00"))], "r int, num int, line string")
    df = P.purchases(lines, "r", "num", "line")
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    assert df._jdf.queryExecution().optimizedPlan().toString().count(r"[^\p{L}\p{N}&'()\-/\s]") <= 4
    assert sorted((r.place, r.description, r.quantity, r.price, r.confidence) for r in df.collect()) == [(1, "Tea bags", 1.0, 2.5, 96), (2, "Oat milk", 2.0, 2.5, 98), (3, "Rice", 1.0, 4.0, 96)]


def test_patterns_that_share_their_beginning_say_the_same(spark):
    import re

    from basketry.functions import parsing as P

    lists = ((P.SUMMARY, *P.HARD_STOPS), (*P.IGNORED, P.PROMOTION), P.SKIPPED, (P.PHOTO_PROMOTION, *P.HARD_STOPS), (P.PHOTO_HEADER, P.PHOTO_SUMMARY), (r"\ba\b|b", r"\bc[|)]d", r"\be\|f"))
    texts = ["TOTAL $12.34", "  grand  total", "subtotal 3", "my visa", "visage", "Authorisation 3", "3 for $2", "for $2", "therefore $3", "save", "----", "ab", "xb", "c|d", "xc|d", "e|f", "xe|f", "card no", "^promotional price", "thank you", "POS 1", "a gst", "GST 1"]
    for patterns in lists:
        assert [bool(re.search("(?i)" + P.either(patterns), t)) for t in texts] == [any(re.search("(?i)" + p, t) for p in patterns) for t in texts]
    # a word's edge is looked for once, not for each pattern
    assert P.either(P.HARD_STOPS).count(r"|\b") == 1


def test_a_line_that_says_a_product_meets_no_products_of_merely_alike_words(spark):
    import itertools

    from basketry.functions import receipts as P

    # each word is alike (0.75) to each other one, so that all names may be meant by all lines, but not against the name itself
    names = [" ".join(x) for x in itertools.product(["mil" + x for x in "abcdef"], repeat=3)]
    catalogue = spark.createDataFrame([(i, x, f"{i}g") for i, x in enumerate(names)], "id int, name string, pack string")
    lines = catalogue.select(F.explode(F.array("name", F.concat_ws(" ", "name", "pack"))).alias("line"))
    # names of the same words in another order are left
    assert P.candidate_pairs(lines, catalogue)[2].count() < 0.1 * 2 * len(names) ** 2
    got = {x.line: x.id for x in P.matched_lines(lines, catalogue).collect()}
    assert [got[f"{x} {i}g"] for i, x in enumerate(names)] == list(range(len(names)))
