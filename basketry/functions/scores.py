"""Scores of how well a listing, an image or a record fits a product.  All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from basketry.functions.numbers import gtin_valid
from basketry.functions.text import normalise, once, words

_PACK = r"([0-9]+(?:\.[0-9]+)?) *(kg|g|l|ml|pack|pk|pieces?|capsules?|tablets?|cans?|bottles?|rolls?)"
_RETAIL_PACK = r"([0-9]+(?:\.[0-9]+)?) *(kg|g|l|ml|pack|pk|capsules?|tablets?|cans?|bottles?|rolls?)"


def plain(c: Column, keep_dot: bool = True) -> Column:
    """Lower case, letters, digits and full stops parted by blanks; "&" is "and", an apostrophe parts words."""
    return normalise(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "&", " and "), "['’]", " "), keep_dot, False)


def digits(c: Column) -> Column:
    """The digits of a number, or null if it has none."""
    return F.nullif(F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9]", ""), F.lit(""))


def long_words(normal: Column) -> Column:
    return F.filter(words(normal), lambda w: F.length(w) > 1)


def share_of(wanted: Column, found: Column) -> Column:
    """The share of the words wanted, repeats included, that are found; 0 if none are wanted."""
    share = lambda v: F.when(F.size(v["w"]) > 0, F.size(F.filter(v["w"], lambda w: F.array_contains(v["f"], w))) / F.size(v["w"])).otherwise(F.lit(0.0))
    return once(F.struct(wanted.alias("w"), found.alias("f")), share)


def _pack(c: Column, pattern: str, pieces: bool) -> Column:
    def made(v: Column) -> Column:
        amount, unit = v["amount"], v["unit"]
        number = amount.try_cast("double") * F.when(unit.isin("kg", "l"), 1000).otherwise(1)
        whole = once(number, lambda n: F.when(n == F.floor(n), F.floor(n).cast("string")).otherwise(n.cast("string")))
        base = F.when(unit.isin("kg"), "g").when(unit == "l", "ml").when(unit.isin("pk", *(["piece", "pieces"] if pieces else [])), "pack").otherwise(F.regexp_replace(unit, "s$", ""))
        return F.when(amount != "", F.concat(whole, base))

    return once(F.struct(F.regexp_extract(c, pattern, 1).alias("amount"), F.regexp_extract(c, pattern, 2).alias("unit")), made)


def pack_of_list(c: Column) -> Column:
    """A pack size in base units ("2 kg" is "2000g"); of a text without one, the text; null for null."""
    return F.when(c.isNotNull(), once(plain(c), lambda n: F.coalesce(_pack(n, _PACK, True), n)))


def pack_of_listing(c: Column) -> Column:
    """A pack size in base units, or null."""
    return once(plain(c), lambda n: _pack(n, _RETAIL_PACK, False))


def live_score(name: Column, brand: Column, pack: Column, gtin: Column, other: Column, other_pack: Column, other_gtin: Column, substitutes: bool = False) -> Column:
    """Struct of score and exact of an offer against what a list asks for; null if it doesn't fit."""

    def scored(v: Column) -> Column:
        mine, theirs, x, y, b, ratio, same_pack = (v[k] for k in ("mine", "theirs", "x", "y", "b", "ratio", "same"))
        made = lambda s, e: F.struct(s.cast("double").alias("score"), e.alias("exact"))
        clash = (mine.isNotNull() & theirs.isNotNull()) & (mine != theirs)
        wrong = F.lit(not substitutes) & (((b != "") & ~y.contains(b)) | ~same_pack)
        score = (
            F.when(mine == theirs, made(F.lit(10_000), F.lit(True)))
            .when(clash | wrong, None)
            .when(y == x, made(F.lit(1000) + F.when(same_pack, 80).otherwise(0), F.lit(True)))
            .when(y.contains(x) & (ratio >= 0.8), made(900 + ratio * 50 + F.when(same_pack, 50).otherwise(-100), same_pack))
            .when((ratio >= 0.75) & same_pack, made(750 + ratio * 100, F.lit(True)))
        )
        return score.when(F.lit(substitutes) & (ratio >= 0.45), made(400 + ratio * 100 + F.when(same_pack, 30).otherwise(-80), F.lit(False)))

    # what the cases look at is computed once: normal forms, then what follows from these
    forms = F.struct(digits(gtin).alias("mine"), digits(other_gtin).alias("theirs"), plain(name).alias("x"), plain(other).alias("y"), plain(brand).alias("b"), pack_of_list(pack).alias("p"), pack_of_list(other_pack).alias("q"))
    same = lambda v: v["p"].isNull() | v["q"].isNull() | (v["p"] == v["q"])
    return once(forms, lambda v: once(F.struct(*[v[k].alias(k) for k in ("mine", "theirs", "x", "y", "b")], share_of(long_words(v["x"]), words(v["y"])).alias("ratio"), same(v).alias("same")), scored))


def listing_score(name: Column, brand: Column, pack: Column, gtin: Column, other: Column, other_pack: Column, other_gtin: Column, bonus: Column) -> Column:
    """How surely a retailer's listing is a product; null if their numbers differ."""
    packed = lambda c: F.regexp_replace(c, "[^a-z0-9]+", "")

    def scored(v: Column) -> Column:
        mine, theirs, x, y, b, n, p, q = (v[k] for k in ("mine", "theirs", "x", "y", "b", "n", "p", "q"))
        score = share_of(long_words(x), long_words(y)) * 1000 + F.when(y == n, 1200).otherwise(0) + F.when(packed(y).contains(packed(n)), 700).otherwise(0)
        score = score + F.when(b == "", 0).when(y.contains(b), 600).otherwise(-700) + F.when(p.isNull() | q.isNull(), 0).when(p == q, 900).otherwise(-1200)
        return F.when(mine == theirs, F.lit(20_000.0)).when(mine.isNotNull() & theirs.isNotNull(), None).otherwise(score + v["bonus"])

    forms = {"mine": digits(gtin), "theirs": digits(other_gtin), "x": plain(F.concat_ws(" ", brand, name)), "y": plain(other), "b": plain(brand), "n": plain(name), "p": pack_of_listing(F.coalesce(pack, name)), "q": pack_of_listing(F.coalesce(other_pack, other)), "bonus": bonus}
    return once(F.struct(*[x.alias(k) for k, x in forms.items()]), scored)


def candidate_score(name: Column, brand: Column, pack: Column, other: Column, other_pack: Column, other_gtin: Column) -> Column:
    """0.75 for the name, 0.15 for the brand and 0.1 for the pack; null without a valid number."""
    by_name = share_of(long_words(plain(name)), words(plain(other)))
    by_brand = F.when(brand.isNull() | plain(other).contains(plain(brand)), 1.0).otherwise(0.0)
    by_pack = F.when(pack.isNull() | other_pack.isNull() | (plain(pack) == plain(other_pack)), 1.0).otherwise(0.0)
    return F.when(gtin_valid(other_gtin), by_name * 0.75 + by_brand * 0.15 + by_pack * 0.1)


def record_score(confidence: Column, name: Column, energy: Column, **present: Column) -> Column:
    """The confidence of a source, and what a record has besides."""
    worth = {"brand": 8, "image": 10, "pack": 8, "category": 4, "description": 5}
    sum_ = confidence
    for k, c in present.items():
        sum_ = sum_ + F.when(F.coalesce(c, F.lit("")) != "", worth[k]).otherwise(0)
    return sum_ + F.when(energy.isNotNull(), 8).otherwise(0) + F.when(name.rlike(r"(?i)[0-9]+ *(?:mg|g|kg|ml|l|capsules?|tablets?|pack|pk)"), 10).otherwise(0)


def claim_status(name: Column, brand: Column, pack: Column, claimed: Column, claimed_brand: Column, claimed_pack: Column, verified: Column) -> Column:
    """CONFLICT if the names share less than 0.45, the brands less than half, or the packs differ; else VERIFIED or PROVISIONAL."""
    n = lambda c: plain(c, False)
    alike = lambda a, b: share_of(long_words(n(a)), words(n(b)))
    conflict = (alike(name, claimed) < 0.45) | F.coalesce(alike(brand, claimed_brand) < 0.5, F.lit(False)) & brand.isNotNull() & claimed_brand.isNotNull()
    conflict = conflict | (pack.isNotNull() & claimed_pack.isNotNull() & (n(pack) != n(claimed_pack)))
    return F.when(conflict, "CONFLICT").when(verified, "VERIFIED").otherwise("PROVISIONAL")


def image_score(reachable: Column, kind: Column, size: Column, width: Column, height: Column, least: int = 320, preferred: int = 700) -> Column:
    """0 to 100 for an image by what is known of its file."""
    image = F.coalesce(kind.startswith("image/"), F.lit(False))
    short, long = F.least(width, height), F.greatest(width, height)
    known = width.isNotNull() & height.isNotNull()
    ratio = long / F.greatest(F.lit(1), short)
    wrong = (~image).cast("int") + F.coalesce(size < 12_000, F.lit(False)).cast("int") + F.when(known, (short < least).cast("int") + (ratio > 3.2).cast("int")).otherwise(1)
    good = 45 + F.when(image, 15).otherwise(0) + F.when(size >= 30_000, 10).otherwise(0) + F.when(known, F.when(short >= preferred, 25).when(short >= least, 15).otherwise(0) + F.when(ratio <= 1.6, 5).otherwise(0)).otherwise(0)
    return F.when(reachable, F.greatest(F.lit(0), F.least(F.lit(100), good - 12 * wrong))).otherwise(0)


def sourced_image_score(source: Column, size: Column, width: Column, height: Column) -> Column:
    """A candidate image by its source, resolution, framing and size of file, before what follows from its use."""
    short, long = F.least(width, height), F.greatest(width, height)
    known = F.coalesce((width > 0) & (height > 0), F.lit(False))
    by_source = F.when(source == "retailer", 32).when(source == "manufacturer", 26).when(source == "open-food-facts", 15).when(source == "current", 3).otherwise(5)
    sharp = F.when(short >= 800, 35).when(short >= 500, 28).when(short >= 300, 18).when(short >= 160, 5).otherwise(-25)
    framed = F.when(long / short <= 1.8, 15).when(long / short <= 2.8, 7).otherwise(-12)
    return by_source + F.when(known, sharp + framed).otherwise(-8) + F.when(size >= 80_000, 12).when(size >= 25_000, 6).otherwise(0)


def percentage(*present: Column) -> Column:
    """The share of what is present, in whole per cent."""
    n = sum((F.coalesce(p, F.lit(False)).cast("int") for p in present), F.lit(0))
    return F.floor(n * 100 / len(present) + 0.5).cast("int")


def produce_image_score(wanted: Column, found: Column, retailer: Column) -> Column:
    """How surely an image's name is that of produce, by distinct words: 0 unless it has three quarters of them."""
    both = F.size(F.array_intersect(wanted, found))
    coverage, precision = both / F.greatest(F.size(wanted), F.lit(1)), both / F.greatest(F.size(found), F.lit(1))
    return F.when(coverage >= 0.75, F.floor(60 * coverage + 25 * precision + F.when(retailer, 12).otherwise(5) + 0.5)).otherwise(0).cast("int")


def packaged_image_score(wanted: Column, found: Column, retailer: Column, text: Column, other: Column) -> Column:
    """How surely an image's name is that of a packaged product: 0 unless it has 0.72 of its words, and where packs or sizes that both say differ; at most 99."""
    some = lambda c: F.nullif(c, F.lit(""))
    count = lambda c: some(F.regexp_extract(F.lower(c), r"\b(\d{1,3})\s*(?:pack|pk|cans?|bottles?)\b", 1)).cast("int")
    size = lambda c: F.regexp_extract(F.lower(c), r"\b(\d+(?:\.\d+)?)\s*(ml|l|g|kg)\b", 1).try_cast("double")
    unit = lambda c: some(F.regexp_extract(F.lower(c), r"\b(\d+(?:\.\d+)?)\s*(ml|l|g|kg)\b", 2))
    base = lambda c: size(c) * F.when(unit(c).isin("l", "kg"), 1000).otherwise(1)
    kind = lambda c: F.when(unit(c).isin("l", "ml"), "ml").when(unit(c).isin("kg", "g"), "g")
    coverage = F.size(F.array_intersect(wanted, found)) / F.greatest(F.size(wanted), F.lit(1))
    other_pack = F.coalesce(count(text) != count(other), F.lit(False)) | F.coalesce((kind(text) != kind(other)) | (F.abs(base(text) - base(other)) > 0.5), F.lit(False))
    score = F.floor(68 * coverage + 0.5) + F.when(count(text) == count(other), 14).otherwise(0) + F.when((base(text) == base(other)) & (kind(text) == kind(other)), 12).otherwise(0) + F.when(retailer, 8).otherwise(0)
    return F.when((coverage >= 0.72) & ~other_pack, F.least(F.lit(99), score)).otherwise(0).cast("int")
