"""Which retailer a text names, be it misread.  Built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What each retailer's receipts say, in any case; the first retailer that a text names counts.
MARKERS = {
    "coles": (r"\bcoles\b", r"coles supermarkets", r"45\s+004\s+189\s+708"),
    "woolworths": (r"\bwoolworths\b", r"woolworths group", r"the fresh food people", r"everyday rewards", r"\bereceipt\b"),
    "aldi": (r"\baldi\b", r"aldi stores", r"shopping at aldi"),
    "iga": (r"\biga\b",),
    "drakes": (r"\bdrakes\b",),
    "costco": (r"\bcostco\b", r"costco wholesale", r"wholesale australia"),
}


def misreadings(retailer: str) -> int:
    """Letters of the name that a scanner may get wrong."""
    return 3 if len(retailer) >= 10 else 2 if len(retailer) >= 5 else 1


def names_retailer(text: Column, retailer: str) -> Column:
    """Whether a text has one of the retailer's marks, or a line whose letters are its name but for a few; null for null."""
    d, n = misreadings(retailer), len(retailer)

    def near(line: Column) -> Column:
        letters = F.regexp_replace(F.lower(line), "[^a-z]", "")
        long_enough = F.length(letters).between(max(3, n - d), n + d) if n > 6 else F.length(letters) == n
        return long_enough & (F.levenshtein(letters, F.lit(retailer)) <= d)

    return text.rlike("(?i)" + "|".join(MARKERS[retailer])) | F.exists(F.split(text, "\r?\n"), near)


def retailer_of(text: Column) -> Column:
    """The first retailer that a text names, or null."""
    return F.coalesce(*[F.when(names_retailer(text, r), F.lit(r)) for r in MARKERS])
