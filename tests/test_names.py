import pytest
from pyspark.sql import functions as F

from basketry.functions import names as M

# Names, and the product, family, size and preparation that they mean (None: not said here).
IDENTITIES = [
    ("Large Zucchini", "Zucchini", None, "Large", []),
    ("140g asparagus trimmed of woody stalks and cut into 5cm pieces", "Asparagus", "Asparagus", None, ["Trimmed", "Cut Into Pieces"]),
    ("Small Zucchini Cut Into 2cm Thick Slices", "Zucchini", None, "Small", ["Cut Into Thick Slices"]),
    ("Small Green Apple Core Removed", "Green Apple", None, "Small", ["Core Removed"]),
    (".Css 17zggtj Font Style Inherit Font Weight Inherit Webkit Text Decoration Inherit Text Decoration Inherit Apple Cored and", "Apple", None, None, ["Cored"]),
    ("Small Sweet Potato Unpeeled", "Sweet Potato", None, "Small", ["Unpeeled"]),
    ("Spring Onions Thinly Sliced", "Spring Onion", None, None, ["Thinly Sliced"]),
    ("Tablespoons Soy Sauce", "Soy Sauce", "Soy Sauce", None, []),
    ("Avocado Stoned Medium", "Avocado", "Avocado", None, ["Stone Removed"]),
    ("Chicken Breast Horizontally", "Chicken Breast", None, None, ["Cut Direction Removed"]),
    ("Canned Cannellini Or Butter Bean", "Canned Cannellini Bean", None, None, []),
    ("Cm Piece Ginger", "Ginger", None, None, []),
    ("Coriander Leaves To Garnish", "Coriander", "Coriander", None, []),
    ("Extra Pinch Ground Cinnamon", "Ground Cinnamon", "Cinnamon", None, []),
    ("Simply Spread", "Margarine", "Margarine", None, []),
    ("Coles Olive Oil Table Spread", "Coles Olive Oil Table Spread", "Margarine", None, []),
    ("Leek White Part Only", "Leek", "Leek", None, []),
    ("Or Stir Fry Vegetable Mix", "Stir Fry Vegetable Mix", None, None, []),
    ("Plain Greek Yoghurt Plus Teaspoons Extra", "Greek Yoghurt", None, None, []),
    ("Salmon Into Cm Cubes", "Salmon", "Salmon", None, ["Cut Into Cubes"]),
    ("Dutch Carrot Or Baby Carrot Lengthways", "Carrot", "Carrot", None, ["Cut Direction Removed"]),
    ("Carrot Halved Lengthways", "Carrot", None, None, ["Halved", "Cut Direction Removed"]),
    ("Freshly Grated Parmesan", "Parmesan", None, None, ["Grated", "Preparation Modifier Removed"]),
    ("Coles Broccoli Medium approx. 340g", "Broccoli", None, None, []),
    ("Woolworths Dill Fresh Herb 15g", "Dill", None, None, []),
    ("Arnott's Flatbread Dippers Feta & Olive 130g", None, "Flatbread Dippers", None, []),
    ("Rosemary Crackers With Parmesan 150g", None, "Crackers", None, []),
    ("Coles Lactose Free Full Cream Milk 1L", None, "Milk", None, []),
]
PARSED = [
    ("140g asparagus trimmed of woody stalks and cut into 5cm pieces", "Asparagus"),
    ("Plain Greek yoghurt", "Greek Yoghurt"),
    ("Juice of lime", "Lime Juice"),
    ("500ml vegetable stock made from a low-salt stock cube", "Vegetable Stock Cube"),
    ("2 slices toast", "Toast"),
    ("Greek style natural yoghurt mixed with dill", "Greek Yoghurt"),
]
DEPARTMENTS = [
    ("Fresh produce", "Apple", "Fruit & vegetables"), ("Fresh meat", "Chicken Breast", "Meat & seafood"), ("Chilled", "Greek Yoghurt", "Dairy & eggs"), (None, "Basmati Rice", "Pantry"),
    ("Diet cola soft drink", "Pepsi Max", "Drinks"), ("Fresh produce", "KitKat Milo Block", "Confectionery"), ("Cleaning & Household", "Dishwashing Tablets", "Household"),
    ("Other", "Black Beans", "Pantry"), ("Other", "Green Beans", "Fruit & vegetables"), ("Fresh produce", "Eggs", "Dairy & eggs"), ("Alcoholic beverages", "Hard Rated Lemon", "Drinks"), (None, "steam mop", "Other"), (None, "eggplant", "Fruit & vegetables"),
]


def test_identities(spark):
    df = M.identified(spark.createDataFrame([(x[0],) for x in IDENTITIES], "name string"), "name")
    got = {r["name"]: r.identity for r in df.collect()}
    for name, canonical, family, size, preparation in IDENTITIES:
        x = got[name]
        assert canonical is None or x.canonical == canonical, (name, x)
        assert family is None or x.family == family, (name, x)
        assert size is None or x["size"] == size, (name, x)
        assert set(preparation) <= set(x.preparation), (name, x)
        assert 0.65 <= x.confidence <= 0.99
    nothing = M.identified(spark.createDataFrame([("",), ("  ",), (None,), ("Cm Pieces",)], "name string"), "name")
    assert [r.identity for r in nothing.collect()] == [None] * 4


def test_parsed_names(spark):
    df = M.parsed(spark.createDataFrame([(x[0],) for x in PARSED], "name string"), "name")
    assert {r["name"]: r.parsed.canonical for r in df.collect()} == dict(PARSED)
    rows = [("2 x 400 g chopped tomatoes",), ("½ cup low fat Atlantic salmon fillets skin off",), ("beans beans",), ("hummus",)]
    got = {r["name"]: r.parsed for r in M.parsed(spark.createDataFrame(rows, "name string"), "name").collect()}
    a, b = got[rows[0][0]], got[rows[1][0]]
    assert (a.quantity, a.pack_quantity, a.pack_unit, a.canonical, a.key) == (2.0, 400.0, "g", "Tomato", "tomato")
    assert (b.quantity, b.unit, b.canonical, b.variety, b.cut, b.skin, b.variants) == (0.5, "cup", "Salmon", "Atlantic", "Fillet", "off", ["reduced fat"])
    assert (got["beans beans"].canonical, got["hummus"].canonical) == ("Bean", "Hummus")


@pytest.mark.parametrize(("stored", "name", "told"), DEPARTMENTS)
def test_departments(spark, stored, name, told):
    assert spark.range(1).select(M.department(F.lit(name), F.lit(stored).cast("string"))).first()[0] == told


def test_food_identity_shape_and_meal(spark):
    rows = [("Large Tomatoes",), ("Lean beef mince",), ("{color: red}",), ("Coriander bunch",), ("Milk 2 L",)]
    df = M.food_identity(spark.createDataFrame(rows, "name string"), "name").withColumn("shape", M.shape(F.col("food")))
    assert {r["name"]: (r.food, r["shape"]) for r in df.collect()} == {"Large Tomatoes": ("tomato", "COUNT_VARIABLE"), "Lean beef mince": ("beef mince", "WEIGHT_VARIABLE"), "{color: red}": ("", "UNKNOWN"), "Coriander bunch": ("coriander", "BUNCH"), "Milk 2 L": ("milk", "PACKAGED_FIXED")}
    got = spark.range(1).select(M.meal_type(F.array(F.lit("Dip"), F.lit("Snack"))), M.meal_type(F.array().cast("array<string>")), M.unit_name(F.lit("Litres")), M.unit_name(F.lit(None).cast("string"))).first()
    assert tuple(got) == ("Snacks", "Lunch & dinner", "L", "each")


def test_sanitised_and_plain_names(spark):
    rows = [("Css-17zggtj Font Style Inherit Apple Pie",), (". Milk",), ("Oat Milk Oat Milk",), ("x1 junk Full Cream Milk more Full Cream Milk",), ("{a}",), ("123",), ("Tom &amp; Jerry <b>Ice</b>",), (None,)]
    assert [r[0] for r in spark.createDataFrame(rows, "t string").select(M.sanitised(F.col("t"))).collect()] == ["Apple Pie", "Milk", "Oat Milk", "Full Cream Milk", None, None, "Tom & Jerry Ice", None]
    rows = [("Ingredients: Crème fraîche",), ("Emulsifier (Soy Lecithin)",), ("Colour (INS 150d)",), (None,)]
    assert [r[0] for r in spark.createDataFrame(rows, "t string").select(M.food_ingredient(F.col("t"))).collect()] == ["cre me frai che", "soy lecithin", "ins 150d", None]
    got = spark.range(1).select(M.litres(F.lit(1250.0)), M.hours(F.lit(125.4)), M.hours(F.lit(59.0)), M.distance(F.lit(1500.0)), M.distance(F.lit(999.4))).first()
    assert tuple(got) == ("1.25 L", "2 h 5 m", "59 min", "1.50 km", "999 m")
