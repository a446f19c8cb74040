"""Labels of packaged food: servings, nutrients, ingredients and allergens from lines of text.  Built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.functions.text import normalise, once, squeeze

# What stands before a value on a label.
SERVING_SIZE = (r"(?i)^serving\s*size\b", r"(?i)^size\s*per\s*serve\b", r"(?i)^portion\s*size\b", r"(?i)^servingSize(?:Description|Text)?\s*:", r"(?i)^serveSize\s*:")
SERVINGS = (r"(?i)^servings?\s+per\s+(?:pack|package|container)\b", r"(?i)^serves?\s+per\s+pack\b", r"(?i)^number\s+of\s+servings\b", r"(?i)^pack\s+serves\b", r"(?i)^servingsPerPackage\s*:", r"(?i)^numberOfServings\s*:", r"(?i)^servingsPerPack\s*:", r"(?i)^servesPerPack\s*:")
INGREDIENTS = (r"(?i)^ingredients?\s*:", r"(?i)^ingredientsList\s*:", r"(?i)^ingredientStatement\s*:")
# A heading of ingredients that stands alone, and the headings that end its section.
INGREDIENTS_HEADING, SECTION_ENDS = r"(?i)^ingredients?$", r"(?i)^allergens?$|^contains\b|^may contain\b|^nutrition information$|^storage$"
CONTAINS = (r"(?i)^contains\s*:", r"(?i)^allergens?\s*:", r"(?i)^allergenStatement\s*:")
MAY_CONTAIN = (r"(?i)^may contain\s*:", r"(?i)^mayContain\s*:", r"(?i)^mayContainStatement\s*:")
NUTRIENTS = {
    "energy": ("kJ", ("energy", "energy per 100g", "energy per 100ml")),
    "protein": ("g", ("protein", "protein per 100g", "protein per 100ml")),
    "fat": ("g", ("fat total", "total fat", "fat per 100g")),
    "saturated": ("g", ("saturated", "saturated fat", "saturated per 100g")),
    "carbohydrate": ("g", ("carbohydrate", "carbohydrate total", "total carbohydrate", "carbohydrate per 100g")),
    "sugars": ("g", ("sugars", "sugar", "total sugars", "sugars per 100g")),
    "fibre": ("g", ("dietary fibre", "dietary fiber", "fibre", "fiber", "fibre per 100g")),
    "sodium": ("mg", ("sodium", "sodium per 100g")),
}
INGREDIENT_WORDS = "sugar|milk|wheat|flour|cocoa|oil|fat|salt|soy|lecithin|emulsifier|flavour|colour|starch|syrup|butter|yeast|acid|gum|powder|solids|extract|water"


def value_after(lines: Column, marks: tuple[str, ...]) -> Column:
    """What follows the first mark that a line has: on that line, or else the next line; null for none or a word for none."""

    def of(mark: str) -> Column:
        at = F.array_position(F.transform(lines, lambda x: x.rlike(mark)), F.lit(True)).cast("int")
        same = lambda i: F.trim(F.regexp_replace(F.regexp_replace(F.get(lines, i - 1), mark, ""), r"^\s*[:=,-]\s*", ""))
        value = lambda i: F.coalesce(F.nullif(same(i), F.lit("")), F.get(lines, i))
        told = lambda v: F.when(~v.rlike("(?i)^(null|undefined|n/a)$"), F.trim(F.regexp_replace(v, r"""^['"]|['"]$""", "")))
        return once(at, lambda i: F.when(i > 0, once(value(i), told)))

    return F.coalesce(*[of(m) for m in marks])


def number_in(c: Column) -> Column:
    return F.nullif(F.regexp_extract(F.regexp_replace(c, ",", ""), r"<?\s*([0-9]+(?:\.[0-9]+)?)", 1), F.lit("")).cast("double")


def serving(lines: Column) -> Column:
    """Struct of quantity and unit of a serving, in grams or millilitres where it is a weight or volume, and of the servings in a pack."""
    return once(value_after(lines, SERVING_SIZE), lambda size: _serving(size, number_in(value_after(lines, SERVINGS))))


def _serving(size: Column, servings: Column) -> Column:
    pattern = r"(?i)([0-9]+(?:\.[0-9]+)?)\s*(kg|g|ml|l|item|slice|piece|tablet|capsule)s?\b"
    unit = F.lower(F.nullif(F.regexp_extract(size, pattern, 2), F.lit("")))
    amount = F.nullif(F.regexp_extract(size, pattern, 1), F.lit("")).cast("double") * F.when(unit.isin("kg", "l"), 1000).otherwise(1)
    return F.struct(amount.alias("quantity"), F.when(unit.isin("kg"), "g").when(unit.isin("ml", "l"), "mL").otherwise(unit).alias("unit"), servings.alias("per_package"))


def heading(line: Column) -> Column:
    """What a line says before a colon, normalised, as nutrients are named."""
    return normalise(F.regexp_replace(F.get(F.split(line, ":"), F.lit(0)), "[–—]", " "), False, False)


def amounts_of(lines: Column, unit: str) -> Column:
    """For each line its amounts in the unit."""
    return F.transform(lines, lambda x: F.transform(F.regexp_extract_all(x, F.lit(rf"(?i)(<?\s*[0-9]+(?:\.[0-9]+)?)\s*{unit}\b"), F.lit(1)), number_in))


def nutrient(lines: Column, unit: str, names: tuple[str, ...], reach: int = 20, headings: Column | None = None, amounts: Column | None = None) -> Column:
    """Struct of the first two different amounts in the lines from the nutrient's on: per serving and per 100; one amount stands for both.

    headings and amounts: these of the lines, if the caller has them.
    """
    known = F.array(*[F.lit(n) for n in names])
    hit = lambda k: F.array_contains(known, k) | reduce(lambda a, b: a | b, [F.endswith(k, F.lit(f" {n}")) for n in names])
    at = F.array_position(F.transform(F.transform(lines, heading) if headings is None else headings, hit), F.lit(True)).cast("int")
    # the amounts of all lines within reach, in order; whether a later line is needed shows in the first two alone
    near = lambda i: F.array_distinct(F.flatten(F.slice(amounts_of(lines, unit) if amounts is None else amounts, i, reach)))
    values = once(at, lambda i: F.when(i > 0, near(F.greatest(i, F.lit(1)))))
    first = lambda v: F.get(v, F.lit(0))
    return once(values, lambda v: F.struct(first(v).alias("per_serving"), F.coalesce(F.get(v, F.lit(1)), first(v)).alias("per_100")))


def allergens(c: Column) -> Column:
    """The allergens of a statement, each once; none for null."""
    body = F.regexp_replace(c, r"(?i)^(contains|may contain|allergens?)\s*:?\s*", "")
    parts = F.transform(F.split(body, r"[,;]|\b(?i:and)\b"), lambda x: F.trim(F.regexp_replace(x, r"[.]+$", "")))
    return F.coalesce(F.array_distinct(F.filter(parts, lambda x: x != "")), F.array().cast("array<string>"))


def plausible_ingredients(c: Column) -> Column:
    """A text, cleaned, if it reads like a list of ingredients, else null."""
    return once(squeeze(F.regexp_replace(c, r"(?i)^ingredients?\s*:?\s*", "")), _plausible)


def _plausible(t: Column) -> Column:
    letters, digits = F.length(F.regexp_replace(t, "[^A-Za-z]", "")), F.length(F.regexp_replace(t, "[^0-9]", ""))
    good = (F.length(t) >= 12) & (F.length(t) <= 5000) & ~t.rlike(r"(?i)\$\s*\d|\bsave\s*\$|\bper\s+100g\b|\benergy\b|\bmax\s+load\b|\bnew\s+[a-z]+\b") & (letters >= 10) & (digits <= letters * 0.35)
    return F.when(good & t.rlike(r"(?i)[,;()]|\bcontains\b") & t.rlike(rf"(?i)\b(?:{INGREDIENT_WORDS})\b"), t)


def section_after(lines: Column, heading: str, ends: str) -> Column:
    """The lines behind the first that is the heading, up to the next heading that ends it, joined by blanks; null for none."""
    at = F.array_position(F.transform(lines, lambda x: x.rlike(heading)), F.lit(True)).cast("int")
    rest = F.slice(lines, F.greatest(at, F.lit(0)) + 1, F.size(lines))
    end = F.array_position(F.transform(rest, lambda x: x.rlike(ends)), F.lit(True)).cast("int")
    body = F.when(end > 0, F.slice(rest, F.lit(1), F.greatest(end - 1, F.lit(0)))).otherwise(rest)
    return F.when(at > 0, F.nullif(F.trim(F.array_join(body, " ")), F.lit("")))


def with_label(df: DataFrame, lines: str, out: str = "label") -> DataFrame:
    """df with a struct of what the lines of a label say: serving, nutrients, ingredients, contains, may_contain, confidence; null if they are no label."""
    x = F.col(lines)
    units = sorted({unit for unit, _ in NUTRIENTS.values()})
    # each line is read once for its heading and once for the amounts of each unit, whatever the nutrients
    df = df.withColumns({f"__{out}_h": F.transform(x, heading)} | {f"__{out}_in_{u}": amounts_of(x, u) for u in units})
    df = df.withColumns({f"__{out}_{k}": nutrient(x, *v, headings=F.col(f"__{out}_h"), amounts=F.col(f"__{out}_in_{v[0]}")) for k, v in NUTRIENTS.items()} | {f"__{out}_s": serving(x), f"__{out}_i": plausible_ingredients(F.coalesce(value_after(x, INGREDIENTS), section_after(x, INGREDIENTS_HEADING, SECTION_ENDS))), f"__{out}_z": value_after(x, SERVING_SIZE)})
    parts = {k: F.col(f"__{out}_{k}") for k in NUTRIENTS}
    known = [F.col(f"__{out}_z"), F.col(f"__{out}_s.per_package"), F.col(f"__{out}_i"), *[p["per_100"] for p in parts.values()]]
    score = sum((k.isNotNull().cast("int") for k in known), F.lit(0))
    is_label = F.exists(x, lambda y: y.rlike(r"(?i)nutrition information|serving size|servings per|servesPerPack|ingredients?\s*:"))
    whole = F.struct(F.col(f"__{out}_s").alias("serving"), F.struct(*[p.alias(k) for k, p in parts.items()]).alias("nutrients"), F.col(f"__{out}_i").alias("ingredients"), allergens(value_after(x, CONTAINS)).alias("contains"), allergens(value_after(x, MAY_CONTAIN)).alias("may_contain"), F.least(F.lit(1.0), score / 11).alias("confidence"))
    return df.withColumn(out, F.when(is_label, whole)).drop(*[f"__{out}_{k}" for k in (*NUTRIENTS, "s", "i", "z", "h", *[f"in_{u}" for u in units])])
