"""Lines of receipts as a parser sees them: kinds, clean descriptions, quantities, and where purchases begin and end.  Built-in expressions."""

from __future__ import annotations

import re
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from basketry.operators.sequence import carried, followed, section

# What lines say, in the order of the lists that they stand for.
MONEY = r"-?\$?\s*\d+[.,]\d{2}\b"
HARD_STOPS = (
    r"^\s*(?:payment|payments?)\b", r"^\s*eft\b", r"\bcredit\s+account\b", r"\bdebit\s+account\b", r"\beftpos\b", r"\bnab\s+visa\b", r"\bvisa\b", r"\bmastercard\b", r"\bapproved\b",
    r"\bauth(?:orisation|orization)?\b", r"\brrn\b", r"\bterminal\b", r"\bcard\s*(?:no|number|sales)\b", r"\bcustomer\s+copy\b", r"\bcommonwealth\s+bank\b",
)
IGNORED = (
    r"^\s*(?:subtotal|sub-total|grand\s+total|amount\s+due)\b", r"^\s*(?:gst|tax|change|cash|tendered)\b", r"^\s*(?:saving|savings|you\s+saved)\b", r"^\s*(?:receipt|invoice|tax\s+invoice)\b",
    r"^\s*(?:abn|store|served\s+by|operator|register|date|time)\b", r"^\s*(?:thank\s+you|www\.|tel\b|phone\b|flybuys\b|everyday\s+rewards\b)", r"^[-_=*\s]+$",
)
SUMMARY = r"^\s*(?:grand\s+total|amount\s+due|total\s+for\s+\d+\s+items?|total\s*\(\s*\d+\s+items?\s*\)|total)\b"
PROMOTION = r"\b(?:for\s*\$?\d+|special|promo|promotion|multibuy|multi-buy|save)\b"
DESCRIPTION = r"^\s*description\b"
SKIPPED = (r"^\s*\^?promotional\s+price\b", r"^\s*#?total\s+includes\s+gst\b")
QUANTITY = r"^\s*(?:qty\s+)?(\d+(?:\.\d+)?)\s*@\s*\$?\s*(\d+[.,]\d{2})\s*(?:each|ea\.?)?"
#: What is taken from a description: a count in front, marks in front, a stray x; then what is no letter, number or one of a few signs becomes a blank.
CLEANED = ((r"^\d+(?:\.\d+)?\s*[xX]\s*", ""), (r"^[*%^#~]+\s*", ""), (r"^[xX]\s+([\p{L}\p{N}])", "$1"), (r"[^\p{L}\p{N}&'()\-/\s]", " "), (r"\s+", " "))
# Fixed values of photographed receipts.
PHOTO_PAYMENT = r"^(?:payment|payments?|eft|eftpos|visa|mastercard|merch\s+id|card|purchase|change)\b"
PHOTO_HEADER = r"^(?:woolworths|the fresh food people|coles supermarkets|tax invoice|abn|store|store manager|phone|served by|register|receipt|date|time|pos\b|description\b|price\b)"
PHOTO_SUMMARY = r"^(?:(?:\d+\s+)?subtotal|(?:grand\s+)?total\b|gst\b|total includes gst|you saved|saving|savings)"
PHOTO_PROMOTION = r"\b(?:special|promo(?:tional)?|save|redeemed\s+free|\d+\s+for\s+\$?\d)|(?:for\s+\$?\d)"
PHOTO_TOTAL = r"^(?:grand\s+)?(?:total|[\[({]?otal)(?:\s+for\s+\d+\s+items?|\s*\(\s*\d+\s+items?\s*\))?\b"
PHOTO_COUNT, PHOTO_SUM, PHOTO_GST = r"^\d+\s+items?:?$", r"^(?:total\s*)?\$?\s*\d+[.,]\d{2}$", r"^total includes gst"
PHOTO_QUANTITY, PHOTO_PACK = r"^(?:qty\s+)?\d+(?:\.\d+)?\s*@", r"\b\d+(?:\.\d+)?\s*(?:ml|l|litres?|liters?|g|grams?|kg|packs?)\b"
TRANSACTION = r"\bpos\b.*\btrans\b"


def _alone(pattern: str) -> bool:
    """Whether a pattern is one alternative, so that what stands before it holds for all of it."""
    bare = re.sub(r"\\.|\[[^\]]*\]", "", pattern)
    return "|" not in "".join(x for x, depth in zip(bare, accumulate((x == "(") - (x == ")") for x in bare), strict=True) if depth == 0)


def either(patterns: tuple[str, ...]) -> str:
    """One pattern for all: those that begin alike, at the start or at a word's edge, share that beginning, which most places of a text fail by."""
    said = []
    for begin in (r"^\s*", r"\b"):
        rest = [p[len(begin):] for p in patterns if p.startswith(begin) and _alone(p)]
        said += [begin + "(?:" + "|".join(f"(?:{p})" for p in rest) + ")"] if rest else []
    return "|".join(said + [f"(?:{p})" for p in patterns if not (p.startswith((r"^\s*", r"\b")) and _alone(p))])


def says(c: Column, *patterns: str) -> Column:
    """Whether a text has one of the patterns, in any case."""
    return c.rlike("(?i)" + either(patterns))


def line_text(c: Column) -> Column:
    """A line without bars and braces, its white space single."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, "[|{}]", " "), r"\s+", " "))


def cleaned(c: Column) -> Column:
    for pattern, to in CLEANED:
        c = F.regexp_replace(c, pattern, to)
    return F.trim(c)


def money(c: Column) -> Column:
    """An amount as it stands on a line."""
    return F.regexp_replace(F.regexp_replace(c, r"[\s$]", ""), ",", ".").try_cast("double")


def last_amount(c: Column) -> tuple[Column, Column, Column]:
    """How many amounts a line has, the last one, and what stands before it."""
    found = F.regexp_extract_all(c, F.lit(f"({MONEY})"), F.lit(1))
    raw = F.try_element_at(found, F.lit(-1))
    behind = F.call_function("substring_index", c, raw, F.lit(-1))
    return F.size(found), money(raw), F.substring(c, F.lit(1), F.length(c) - F.length(behind) - F.length(raw))


def saleable(c: Column) -> Column:
    """Whether a clean description can be that of a purchase."""
    return (F.length(c) >= 2) & c.rlike("(?i)[a-z]") & ~says(c, *HARD_STOPS, *IGNORED, SUMMARY)


def purchases(lines: DataFrame, key: str, number: str, text: str) -> DataFrame:
    """Per receipt (key), the purchases that its lines, in order of number, tell of: place, description, quantity, price, confidence.

    Purchases stand behind the heading "description" and before the first total or payment.  A line of words is the description of what is priced next:
    by a line of quantity and unit price, or by an amount that stands alone.  A line with words and an amount is a purchase by itself.  A line of quantity
    that no description waits for gives the purchase before it its quantity and price.  Null and blank lines say nothing; a receipt without
    purchases has no rows.  Two lines of one number are taken in the order of their texts.
    """
    c, keys, order = F.col, [key], [F.col(number), F.col("__t")]
    rows = lines.select(c(key), c(number), line_text(c(text)).alias("__t")).filter("__t <> ''").withColumn("__head", says(c("__t"), DESCRIPTION))
    rows = section(rows, keys, order, c("__head"), ~c("__head") & says(c("__t"), SUMMARY, *HARD_STOPS)).filter(~c("__head") & ~says(c("__t"), *SKIPPED)).drop("__head")
    count, last, before = last_amount(c("__t"))
    rows = rows.withColumns({"n": count, "last": last, "before": before, "amount": F.regexp_extract("__t", "(?i)" + QUANTITY, 1).try_cast("double")})
    rows = rows.withColumn("unit", F.when(c("amount").isNotNull(), money(F.regexp_extract("__t", "(?i)" + QUANTITY, 2))))
    kind = F.when(c("amount").isNotNull(), "quantity").when((c("n") > 0) & (c("before") == ""), "amount").when(c("n") > 0, "priced").when(~says(c("__t"), *IGNORED, PROMOTION) & c("__t").rlike("(?i)[a-z]"), "words").otherwise("other")
    # what a description is worth is found where it stands, once, and carried with it; each step is null for other kinds of lines
    rows = rows.withColumn("kind", kind).withColumn("own", F.when(c("kind") == "priced", cleaned(c("before"))).when(c("kind") == "words", cleaned(c("__t"))))
    rows = rows.withColumn("once", cleaned(c("own"))).withColumn("twice", F.when(c("kind") == "words", cleaned(c("once"))))
    rows = rows.withColumn("fits", saleable(c("once")))
    rows = rows.withColumns({"named": (c("kind") == "priced") & (c("own") != "") & c("fits") & ~says(c("own"), r"^qty\b"), "sold": F.when(c("kind") == "words", ~says(c("once"), r"^qty\b") & saleable(c("twice")))})
    closes = lambda x: (c("kind") == "quantity") | c("named") | ((c("kind") == "amount") & x["sold"])
    rows = carried(rows, keys, order, F.when(c("kind") == "words", F.struct("own", "once", "twice", "fits", "sold")), closes, "open")
    waits = F.coalesce(c("open.own"), F.lit("")) != ""
    description = F.when(c("named"), c("once")).when((c("kind") == "amount") & waits & c("open.sold"), c("open.twice")).when((c("kind") == "quantity") & waits & c("open.fits"), c("open.once"))
    total = F.when(c("kind") == "quantity", F.when(c("n") > 1, c("last")).otherwise(F.floor(c("amount") * c("unit") * 100 + 0.5) / 100)).otherwise(c("last"))
    rows = rows.withColumns({"description": description, "quantity": F.when(c("kind") == "quantity", c("amount")).otherwise(1.0), "price": total, "told": c("description").isNotNull() | ((c("kind") == "quantity") & ~waits)})
    place = F.count("description").over(_running(key, number))
    facts = rows.withColumn("place", place).filter("told and place > 0")
    latest = F.max_by(F.struct("quantity", "price"), F.struct(c(number), c("__t"))).alias("l")
    sure = F.when(F.count_if(c("kind") == "quantity") > 0, 98).otherwise(96).alias("confidence")
    return facts.groupBy(key, "place").agg(F.max("description").alias("description"), latest, sure).select(key, "place", "description", "l.quantity", "l.price", "confidence")


def _running(key: str, number: str) -> WindowSpec:
    return Window.partitionBy(key).orderBy(number, "__t").rowsBetween(Window.unboundedPreceding, 0)


def regions(lines: DataFrame, key: str, number: str, text: str) -> DataFrame:
    """Per receipt: the numbers (from 0, of its lines that aren't blank) where purchases start and end, and whose mark the start is.

    They end at the total: a line that says so with an amount, or with one on the next line that is no payment, or a count of items with the amount within two
    lines; without one, behind the last line.  They start behind the heading, or behind the line of the transaction, or at the first priced line that another
    one, a quantity or a promotion follows within three; up to three lines with a pack size right before that one belong to it.  Without any, they
    start where they end.
    """
    c = F.col
    w = Window.partitionBy(key).orderBy(number, "t")
    rows = lines.select(c(key), c(number), line_text(c(text)).alias("t")).filter("t <> ''")
    # all that a line says by itself is taken from it before lines are dealt and sorted, once; a line's place and its neighbours' marks are windows of that order
    above = F.size(F.filter(F.transform(F.regexp_extract_all("t", F.lit(f"({MONEY})"), F.lit(1)), money), lambda v: v > 0)) > 0
    rows = rows.withColumns({"money": c("t").rlike(MONEY), "pay": says(c("t"), PHOTO_PAYMENT), "head": says(c("t"), PHOTO_HEADER, PHOTO_SUMMARY), "promotion": says(c("t"), PHOTO_PROMOTION)})
    rows = rows.withColumns({
        "count": says(c("t"), PHOTO_COUNT), "sum": says(c("t"), PHOTO_SUM), "says": says(c("t"), PHOTO_TOTAL) & ~says(c("t"), PHOTO_GST), "has": c("money") & ~c("pay"),
        "heading": says(c("t"), r"^description\b"), "transaction": says(c("t"), TRANSACTION), "theirs": says(c("t"), r"\bwoolworths\b"),
        "priced": c("money") & ~c("head") & ~c("pay") & ~c("promotion") & c("t").rlike("(?i)[a-z]{2,}") & above, "packed": ~c("head") & says(c("t"), PHOTO_PACK) & c("t").rlike("(?i)[a-z]{3,}"), "goes": c("promotion") | says(c("t"), PHOTO_QUANTITY),
    })
    rows = rows.drop("pay", "head", "promotion")
    ahead = lambda x, n=1: F.lead(x, n, False).over(w)
    total = (c("count") & (ahead("sum") | ahead("sum", 2))) | (c("says") & (c("money") | ahead("has")))
    rows = rows.withColumns({"i": F.row_number().over(w) - 1, "total": total})
    at = lambda p: F.min(F.when(p, c("i")))
    all_ = Window.partitionBy(key)
    rows = rows.withColumn("end", F.coalesce(at(c("total")).over(all_), F.count(F.lit(1)).over(all_)))
    inside = c("i") < c("end")
    told = [F.first("end").alias("end"), at(c("heading")).alias("heading"), F.when(F.max("theirs"), at(c("transaction"))).alias("transaction")]
    ends = followed(rows, [key], [c(number), c("t")], inside & c("priced"), inside & (c("priced") | c("goes")), 3, inside & c("packed"), 3, *told)
    start = F.coalesce(c("heading") + 1, c("transaction") + 1, "start", "end")
    by = F.when(c("heading").isNotNull(), "heading").when(c("transaction").isNotNull(), "transaction").when(c("start").isNotNull(), "merchandise").otherwise("none")
    return ends.select(key, start.cast("int").alias("start"), c("end").cast("int").alias("end"), by.alias("mark"))
