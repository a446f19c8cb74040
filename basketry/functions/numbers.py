"""Money, units, identifiers and dates over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from basketry.functions.text import normalise, once
from basketry.functions.vocabulary import FRACTIONS

EPSILON = 2.220446049250313e-16
# Dimension and factor of each unit.
UNITS = {
    "g": ("mass", 1.0), "gram": ("mass", 1.0), "grams": ("mass", 1.0), "kg": ("mass", 1000.0),
    "ml": ("volume", 1.0), "millilitre": ("volume", 1.0), "millilitres": ("volume", 1.0), "l": ("volume", 1000.0), "litre": ("volume", 1000.0), "litres": ("volume", 1000.0),
    "each": ("count", 1.0), "item": ("count", 1.0), "items": ("count", 1.0),
}
COUNT_UNITS = ("item", "each", "ea", "pack", "packet", "tin", "can", "bottle")


def round_half_up(c: Column, digits: int = 0) -> Column:
    """Ties go towards plus infinity, also below zero."""
    scale = 10.0**digits
    return F.floor(c * scale + 0.5) / scale


def round_money(c: Column) -> Column:
    return F.floor((c + EPSILON) * 100 + 0.5) / 100


def cents(c: Column) -> Column:
    """Whole cents: sums of these don't depend on the order of rows."""
    return F.floor((c + EPSILON) * 100 + 0.5)


def comparable_price(price: Column, quantity: Column, unit: Column) -> Column:
    """Struct of price and label: per 100 g, per L, or per unit.  No or no positive quantity counts as one."""
    q = F.when(quantity > 0, quantity).otherwise(F.lit(1.0))
    u = F.coalesce(F.lower(F.trim(unit)), F.lit("item"))
    single = F.when(u == "", "item").when(u.isin("items", "packs", "tins", "cans"), u.substr(F.lit(1), F.length(u) - 1)).otherwise(u)
    value = F.when(u.isin("kg", "kilogram", "kilograms"), price / (q * 1000) * 100).when(u.isin("g", "gram", "grams"), price / q * 100)
    value = value.when(u.isin("ml", "millilitre", "millilitres", "milliliter", "milliliters"), price / q * 1000).otherwise(price / q)
    label = F.when(u.isin("kg", "kilogram", "kilograms", "g", "gram", "grams"), "per 100 g")
    label = label.when(u.isin("l", "litre", "litres", "liter", "liters", "ml", "millilitre", "millilitres", "milliliter", "milliliters"), "per L").otherwise(F.concat(F.lit("per "), single))
    return F.struct(value.alias("price"), label.alias("label"))


def _of_unit(unit: Column, which: int) -> Column:
    """From a literal map of the units: one look-up, and the unit is normalised once."""
    return F.create_map(*[F.lit(x) for name, value in UNITS.items() for x in (name, value[which])])[normalise(unit)]


def dimension(unit: Column) -> Column:
    return _of_unit(unit, 0)


def factor(unit: Column) -> Column:
    return _of_unit(unit, 1)


def item_multiplier(quantity: Column, unit: Column) -> Column:
    """How often to buy: whole items of count units, else once."""
    counted = normalise(F.coalesce(unit, F.lit("item")), False, False).isin(*COUNT_UNITS)
    return F.when(counted & (quantity > 1), F.ceil(quantity)).otherwise(F.lit(1)).cast("long")


def pack_size(c: Column) -> Column:
    """The first measure of a text in base units: struct of quantity and unit, both null without one."""
    pattern = r"(?i)(?:([0-9]+) ?x ?)?([0-9]+(?:\.[0-9]+)?) ?(kg|g|ml|l)\b"
    times, amount, unit = (F.regexp_extract(c, pattern, i) for i in (1, 2, 3))
    n = F.coalesce(F.nullif(times, F.lit("")).cast("double"), F.lit(1.0))
    base = F.nullif(amount, F.lit("")).cast("double") * n * F.when(F.lower(unit).isin("kg", "l"), 1000.0).otherwise(1.0)
    return F.struct(base.alias("quantity"), F.when(F.lower(unit).isin("kg", "g"), "g").when(F.lower(unit).isin("l", "ml"), "ml").alias("unit"))


def round_half_even(value: Column) -> Column:
    """A number, not negative, to two places, by what the binary number is exactly; of two equally near the even one.

    The part below 1, times 2**62, is a whole number; times 100, it is held in two halves.
    """
    mask = F.lit((1 << 31) - 1).cast("long")

    def halves(v: Column) -> Column:
        whole = F.floor(v)
        bits = ((v - whole) * float(1 << 62)).cast("long")
        return F.struct(v.alias("v"), whole.alias("whole"), (bits.bitwiseAND(mask) * 100).alias("low"), (F.shiftright(bits, 31) * 100).alias("high"))

    def joined(x: Column) -> Column:
        high = x["high"] + F.shiftright(x["low"], 31)
        return F.struct(x["v"].alias("v"), x["whole"].alias("whole"), F.shiftright(high, 31).alias("cents"), (F.shiftleft(high.bitwiseAND(mask), 31) + x["low"].bitwiseAND(mask)).alias("rest"))

    def rounded(x: Column) -> Column:
        up = (x["rest"] > 1 << 61) | ((x["rest"] == 1 << 61) & (x["cents"] % 2 == 1))
        return F.when(x["v"] < 1e13, (x["whole"] * 100 + x["cents"] + up.cast("long")) / 100).otherwise(x["v"])

    return once(value, lambda v: once(halves(v), lambda x: once(joined(x), rounded)))


def parse_price(c: Column) -> Column:
    """A positive amount of money from a text, to two places, or null."""
    return once(F.regexp_replace(c, "[^0-9.]", "").try_cast("double"), lambda value: F.when(value > 0, round_half_even(value)))


def parse_fraction(c: Column) -> Column:
    """"1 1/2", "3/4", "½" or "2.5" as a number; null for anything else."""
    whole, top, bottom = (F.regexp_extract(c, r"^\s*(?:([0-9]+)\s+)?([0-9]+)/([0-9]+)\s*$", i).try_cast("double") for i in (1, 2, 3))
    signs = F.create_map(*[F.lit(x) for pair in FRACTIONS.items() for x in pair])
    return F.coalesce(signs[c], F.when(bottom > 0, F.coalesce(whole, F.lit(0.0)) + top / bottom), F.trim(c).try_cast("double"))


def gtin_valid(c: Column) -> Column:
    """8, 12, 13 or 14 digits whose last is the weighted modulo-10 check of the others."""
    digits = F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9]", "")
    body = F.reverse(F.filter(F.split(digits.substr(F.lit(1), F.length(digits) - 1), ""), lambda x: x != ""))
    weighted = F.transform(body, lambda x, i: x.cast("int") * F.when(i % 2 == 0, 3).otherwise(1))
    total = F.aggregate(weighted, F.lit(0), lambda a, x: a + x)
    return F.length(digits).isin(8, 12, 13, 14) & ((10 - total % 10) % 10 == F.right(digits, F.lit(1)).try_cast("int"))


def with_check_digit(body: Column) -> Column:
    """The digits of body and the check digit that makes them a valid number."""
    weighted = F.transform(F.reverse(F.filter(F.split(body, ""), lambda x: x != "")), lambda x, i: x.cast("int") * F.when(i % 2 == 0, 3).otherwise(1))
    return F.concat(body, ((10 - F.aggregate(weighted, F.lit(0), lambda a, x: a + x) % 10) % 10).cast("string"))


def backoff_seconds(attempt: Column, base: int = 15, most: int = 3600) -> Column:
    return F.least(F.lit(float(most)), base * F.pow(F.lit(2.0), F.greatest(attempt - 1, F.lit(0)))).cast("long")


def per_serving(per_100: Column, serving: Column) -> Column:
    return per_100 * serving / 100


def kilojoules(kilocalories: Column) -> Column:
    return kilocalories * 4.184


def servings_per_pack(pack: Column, serving: Column) -> Column:
    """To one place; null unless both are positive."""
    return F.when((pack > 0) & (serving > 0), round_half_up(pack / serving, 1))


#: Amounts of a derived product that one of its source gives, by unit (fixed values): millilitres of juice in a lemon.
LEMON_ML, TBSP_ML, TSP_ML, CUP_ML = 45.0, 15.0, 5.0, 250.0


def lemons_for_juice(quantity: Column, unit: Column) -> Column:
    """Whole lemons that give the juice; null for other units."""
    u = normalise(unit)
    ml = F.when(u == "ml", quantity).when(u == "l", quantity * 1000).when(u.isin("tbsp", "tablespoon", "tablespoons"), quantity * TBSP_ML)
    ml = ml.when(u.isin("tsp", "teaspoon", "teaspoons"), quantity * TSP_ML).when(u.isin("cup", "cups"), quantity * CUP_ML)
    return F.ceil(ml / LEMON_ML)


def fingerprint(lines: Column) -> Column:
    """SHA-256 of a list of lines, each trimmed and in lower case, empty ones left out."""
    return F.sha2(F.array_join(F.filter(F.transform(lines, lambda x: F.lower(F.trim(x))), lambda x: x != ""), "\n"), 256)


def expiry_status(expires: Column, as_of: str, soon_days: int = 3) -> Column:
    """expired, soon or ok, by the end of the expiry day; ok without a date."""
    end = F.timestamp_seconds(F.unix_seconds(F.date_trunc("day", expires)) + 86_399)
    left = F.unix_seconds(end) - F.unix_seconds(F.lit(as_of).cast("timestamp"))
    return F.when(left < 0, "expired").when(left <= soon_days * 86_400, "soon").otherwise("ok")


def week_start(ts: Column, zone: str = "Australia/Brisbane") -> Column:
    """The Monday of the week, by the zone's wall clock."""
    return F.date_trunc("week", F.from_utc_timestamp(ts, zone)).cast("date")


def greeting(ts: Column, zone: str = "Australia/Brisbane") -> Column:
    h = F.hour(F.from_utc_timestamp(ts, zone))
    return F.when(h < 12, "morning").when(h < 17, "afternoon").otherwise("evening")


def iso_minutes(c: Column) -> Column:
    """Minutes of an ISO-8601 duration in days, hours and minutes, or null."""
    d, h, m = (F.coalesce(F.regexp_extract(c, rf"([0-9]+){x}", 1).try_cast("long"), F.lit(0)) for x in ("D", "H", "M"))
    return F.when(c.rlike(r"^P(?=.)([0-9]+D)?(T(?=.)([0-9]+H)?([0-9]+M)?)?$"), d * 1440 + h * 60 + m)


def day_first_date(c: Column) -> Column:
    """The first day/month/year of a text that is a date; two-digit years are of this century."""
    found = F.regexp_extract_all(c, F.lit(r"\b([0-9]{1,2}[/.-][0-9]{1,2}[/.-](?:[0-9]{4}|[0-9]{2}))\b"), F.lit(1))

    def made(x: Column) -> Column:
        p = F.split(x, "[/.-]")
        year = p[2].cast("int") + F.when(F.length(p[2]) == 2, 2000).otherwise(0)
        return F.try_to_date(F.concat_ws("-", year.cast("string"), F.lpad(p[1], 2, "0"), F.lpad(p[0], 2, "0")), "yyyy-MM-dd")

    return F.get(F.array_compact(F.transform(found, made)), F.lit(0))
