import datetime
import random
import re

from pyspark.sql import functions as F

from basketry.functions import labels as L
from basketry.functions import receipts as P
from basketry.functions import text as T
from basketry.operators.fuzzy import alike, alike_words

# A label that is known.
PANEL = """<h2>NUTRITION INFORMATION</h2><p>Servings per package: 9</p><p>Serving size: 17.2 g</p><table>
<tr><th>Energy</th><td>389 kJ</td><td>2263 kJ</td></tr><tr><th>Protein</th><td>0.8 g</td><td>4.5 g</td></tr><tr><th>Fat, total</th><td>5.5 g</td><td>31.8 g</td></tr><tr><th>- saturated</th><td>3.1 g</td><td>18.2 g</td></tr>
<tr><th>Carbohydrate</th><td>9.4 g</td><td>54.5 g</td></tr><tr><th>- sugars</th><td>7.8 g</td><td>45.5 g</td></tr><tr><th>Sodium</th><td>12.5 mg</td><td>72.7 mg</td></tr></table>
<p>Ingredients: Sugar, milk solids, cocoa butter.</p><p>Contains: Milk, Soy, Wheat</p><p>May contain: Tree Nuts</p>"""


def test_label(spark):
    df = spark.createDataFrame([(1, PANEL), (2, "<p>nothing here</p>"), (3, None), (4, "Serving size: 1.5 L\nIngredients: water")], "k int, html string").withColumn("lines", T.html_lines(F.coalesce("html", F.lit(""))))
    got = {r.k: r.label for r in L.with_label(df, "lines").collect()}
    x = got[1]
    assert (x.serving.quantity, x.serving.unit, x.serving.per_package) == (17.2, "g", 9.0)
    assert (x.nutrients.energy.per_serving, x.nutrients.energy.per_100, x.nutrients.sodium.per_100, x.nutrients.saturated.per_100, x.nutrients.fibre.per_100) == (389.0, 2263.0, 72.7, 18.2, None)
    assert x.ingredients == "Sugar, milk solids, cocoa butter." and x.contains == ["Milk", "Soy", "Wheat"] and x.may_contain == ["Tree Nuts"]
    assert got[2] is None and got[3] is None
    assert (got[4].serving.quantity, got[4].serving.unit, got[4].ingredients) == (1500.0, "mL", None)


def test_lines_of_receipts(spark):
    rows = [("- Milk | 2 | $3.50",), ("Bread|4",), ("Eggs 12 pack  $6.90 ",), ("Total",), ("a|x|1",), ("",)]
    got = [tuple(r.x) for r in spark.createDataFrame(rows, "t string").select(P.split_line(F.col("t")).alias("x")).collect()]
    assert got == [("Milk", 2.0, 3.5), ("Bread", 1.0, 4.0), ("Eggs 12 pack", 1.0, 6.9), ("Total", 1.0, None), ("a", 1.0, 1.0), ("", 1.0, None)]


def test_roles_and_structure(spark):
    lines = ["COLES", "MILK 2L 7.00", "2 EACH 3.50", "SAVE -1.00", "TOTAL 6.00", "3 ITEMS", "EFT 6.00", "BREAD 4.00", "GST INCLUDED IN TOTAL 0.60", "APPROVED"]
    df = P.classified(spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "k int, i int, t string"), "k", "i", "t")
    assert [r.role for r in df.orderBy("i").collect()] == ["header", "product", "quantity", "promotion", "total", "item-count", "tender", "footer", "tax", "footer"]
    assert [r.score for r in P.structure_score(df, "k", "i").collect()] == [100]


def test_date_and_total(spark):
    texts = ["Store 1/2/23\nDate: 05/03/2024 10:00\nTOTAL 12.50\nTotal savings 1.00", "31/02/2024", "none", "Grand total $9,95\nTotal 3.00"]
    got = [tuple(r) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(P.likely_date(F.col("t")), P.printed_total(F.col("t"))).collect()]
    assert got == [(datetime.date(2024, 3, 5), 12.5), (None, None), (None, None), (None, 9.95)]


# A catalogue, what a scanner read, and the product that it means (None: not clear).
CATALOGUE = [
    ("pepsi", "Pepsi Max Cola No Sugar Soft Drink Bottle", "Pepsi Max Cola", "Pepsi", "1.25L"),
    ("sugar", "Coles Raw Sugar", "Coles Raw Sugar", None, "2kg"),
    ("dare", "Dare Double Espresso Iced Coffee", "Dare Espresso", "Dare", "750ml"),
    ("coffee", "Ice Break Iced Coffee", "Ice Break Iced Coffee", None, "500ml"),
    ("milkybar", "Milkybar White Chocolate Block", "Milkybar Chocolate Block", None, "170g"),
    ("cookie", "KitKat Cookie Dough Chocolate Block", "KitKat Cookie Dough", None, "170g"),
    ("aero", "KitKat Chunky Aero Mint Chocolate Bar", "KitKat Chunky Aero", None, "155g"),
    ("other-aero", "KitKat Chunky Aero", "KitKat Chunky Aero", None, "45g"),
    ("scroll", "Hawaiian Pizza Scroll 2 Pack", "Hawaiian Pizza Scroll", None, "2pack"),
]
LINES = [
    ("PEPST MAX COLA 1.25LITRE", "pepsi"), ("5F FPST MAX COLA 1 25LITRE", "pepsi"), ("LES SUGAR RAW 2KG", "sugar"), ("5 SUGAR RAW 2KG", "sugar"), ("ARE ESPRESSO 750ML 750ML", "dare"), ("T1CE BREAK ICED COFFE 500ML", "coffee"),
    ("ICE BREAK ICED COFFE SOOOML", "coffee"), ("MIL KYRAR CHOC BLOCK 170GRAM", "milkybar"), ("4MILKYBAR CHOC BLOCK 170GRAM 3 7", "milkybar"), ("4KITKAT COOKIE DOUGH 170GRAM", "cookie"), ("ve K11kAT COOKIE DOUGH 170GRAM", "cookie"),
    ("iKTT KAT CHUNKY AERO 1S5GRAM", "aero"), ("KIT KAT CHUNKY AERO 135GRAM", "aero"), ("ICE BREAK ICED COFFE S000ML", "coffee"), ("HAWAIIAN PIZZA SCROL 2PACK", "scroll"), ("KIT KAT CHUNKY", None), ("COLES PRODUCT", None), ("", None),
]
SHOWN = {"5F FPST MAX COLA 1 25LITRE": "Pepsi Max Cola 1.25L", "5 SUGAR RAW 2KG": "Coles Raw Sugar 2kg", "ARE ESPRESSO 750ML 750ML": "Dare Espresso 750ml", "ve K11kAT COOKIE DOUGH 170GRAM": "KitKat Cookie Dough 170g"}


def test_recognised_lines_against_a_catalogue(spark):
    schema = "id string, name string, canonical string, brand string, pack string"
    lines = spark.createDataFrame([(x,) for x, _ in LINES], "line string")
    got = {r.line: (r.id, r.name) for r in P.matched_lines(lines, spark.createDataFrame(CATALOGUE, schema)).collect()}
    assert {line: i for line, (i, _) in got.items()} == {line: told for line, told in LINES if told}
    assert {line: got[line][1] for line in SHOWN} == SHOWN
    # another record of one product is no rival; a flavour that the line doesn't say isn't invented
    more = [*CATALOGUE, ("pepsi-record", "Pepsi Max No Sugar Bottle", "Pepsi Max Cola", "Pepsi", "1.25L")]
    assert {r.line: r.id for r in P.matched_lines(lines, spark.createDataFrame(more, schema)).collect()}["5F FPST MAX COLA 1 25LITRE"] == "pepsi"
    mint = spark.createDataFrame([("mint", "KitKat Aero Mint Chocolate Block", "KitKat Aero Mint Chocolate Block", None, "155g")], schema)
    assert P.matched_lines(spark.createDataFrame([("KIT KAT CHUNKY AERO 155GRAM",)], "line string"), mint).collect() == []


def brute_matches(spark, lines, catalogue):
    """All pairs of lines and products, scored in plain Python over the words that Spark reads."""
    own, known, _ = P.candidate_pairs(lines, catalogue)
    found = {}

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    def alike(a, b):
        if a == b:
            return 1.0
        short, long = sorted((a, b), key=len)
        return 0.8 if len(short) >= 4 and long.startswith(short) else 1 - edits(a, b) / len(long)

    def packs(p, q):
        if p is None or q is None:
            return 0.0
        m, n = (re.fullmatch(r"(\d+)(g|ml|pack)", x) for x in (p, q))
        return 0.16 if p == q else 0.04 if m and n and m[2] == n[2] and edits(m[1], n[1]) == 1 else -0.65

    products = known.collect()
    for r in own.collect():
        ranked = []
        for k in products:
            scores = []
            for words in k.v if r.x else []:
                s = [max(alike(x, w) for x in r.x) for w in words]
                strong, exact = [v for v in s if v >= 0.72], s.count(1.0)
                top = sorted(s, reverse=True)[:3]
                scores.append((max(sum(strong) / len(s) + exact * 0.035, sum(top) / len(top) * 0.72 + min(len(strong), 3) * 0.08 + exact * 0.02), len(strong)))
            if scores and all(any(alike(x, w) >= 0.72 for x in r.x) for w in k.needs):
                ranked.append((-(max(scores)[0] + packs(r.p, k.q)), k.id, k.identity, max(scores)[1], k.display))
        ranked.sort()
        if ranked:
            score, i, identity, n, display = ranked[0]
            rival = next((x for x in ranked if x[2] != identity), None)
            if n >= 2 and -score >= 0.76 and (rival is None or rival[0] - score >= 0.1):
                found[r.line] = (i, display, round(min(1.0, -score), 9))
    return found, len(products)


def test_matching_loses_nothing_and_compares_few(spark):
    r = random.Random(3)
    vocabulary = ["".join(r.choice("abcdeiorst") for _ in range(r.randint(3, 9))) for _ in range(60)]
    names = [" ".join(r.sample(vocabulary, r.randint(1, 4))) for _ in range(150)]
    catalogue = spark.createDataFrame([(i, n, r.choice(["250g", "500g", "1 kg", None]), r.choice([None, "Brand", "acme"]), [r.choice(names)] if i % 9 == 0 else None) for i, n in enumerate(names)], "id int, name string, pack string, brand string, names array<string>")

    def misread(n):
        at = r.randrange(len(n))
        return r.choice([n, n.upper(), n[:at] + r.choice("xyz ") + n[at + 1 :], n[:at] + n[at + 1 :], n + " 250g", "4" + n])

    lines = spark.createDataFrame([(misread(r.choice(names)),) for _ in range(120)] + [(None,), ("",)], "line string")
    told, products = brute_matches(spark, lines, catalogue)
    got = {x.line: (x.id, x.name, round(x.confidence, 9)) for x in P.matched_lines(lines.repartition(3), catalogue).collect()}
    assert got == told
    assert len(got) > 15


def test_few_pairs_on_many_names(spark):
    r = random.Random(8)
    words = ["".join(r.choice("abcdefghiklmnoprstuw") for _ in range(6)) for _ in range(20)]
    names = sorted({" ".join(r.choice(words) for _ in range(3)) for _ in range(800)})
    catalogue = spark.createDataFrame(list(enumerate(names)), "id int, name string")
    _, _, pairs = P.candidate_pairs(catalogue.select(F.col("name").alias("line")), catalogue)
    assert pairs.count() < 0.05 * len(names) ** 2


def test_words_within_an_edit_distance(spark):
    r = random.Random(1)
    a = sorted({"".join(r.choice("abcd") for _ in range(r.randint(1, 10))) for _ in range(250)})
    b = sorted({w[: r.randint(1, len(w))] + r.choice(["", "a", "dd", w]) for w in a})
    left, right = spark.createDataFrame([(w,) for w in [*a, "", None]], "a string"), spark.createDataFrame([(w,) for w in [*b, "", None]], "b string")
    every = left.filter("a <> ''").crossJoin(right.filter("b <> ''")).withColumn("s", alike(F.col("a"), F.col("b")))
    for least in (0.5, 0.69, 0.9):
        told = sorted((x.a, x.b, round(x.s, 9)) for x in every.filter(F.col("s") >= least).collect())
        assert sorted((x.a, x.b, round(x.s, 9)) for x in alike_words(left, right, least).collect()) == told
