"""Text functions over columns: normalising, measures, similarity.  All are built-in expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from basketry.functions import vocabulary as V


def once(c: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body uses it: Spark computes what a lambda repeats each time."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


def squeeze(c: Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(c, r"[ \t\n\r\f\x0B]+", " "))


def normalise(c: Column, keep_dot: bool = True, spell_and: bool = True) -> Column:
    """Lower case, letters and digits only, parted by single blanks.

    keep_dot keeps full stops; spell_and writes "&" as "and" and drops apostrophes instead of parting words at them.
    """
    c = F.lower(c)
    if spell_and:
        c = F.regexp_replace(F.regexp_replace(c, "[’']", ""), "&", " and ")
    return squeeze(F.regexp_replace(c, "[^a-z0-9. ]+" if keep_dot else "[^a-z0-9]+", " "))


def slug(c: Column) -> Column:
    return F.regexp_replace(normalise(c), " ", "-")


def words(c: Column) -> Column:
    """The non-empty words of a normalised text."""
    return F.filter(F.split(c, " "), lambda w: w != "")


def title_case(c: Column, small: tuple[str, ...] = V.SMALL_WORDS) -> Column:
    """First letters upper case, but for small words that don't come first."""
    return F.array_join(F.transform(words(normalise(c)), lambda w, i: F.when((i > 0) & w.isin(*small), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w))))), " ")


def spaced_measures(c: Column) -> Column:
    """"2kg" becomes "2 kg"; stray punctuation goes."""
    c = F.regexp_replace(c, r"(?i)(\d)(kg|g|mg|ml|l)\b", "$1 $2")
    return squeeze(F.regexp_replace(F.regexp_replace(c, r"[,;:]+", " "), r"\.+( |$)", " "))


def singular(w: Column) -> Column:
    """Without a final s, if the word has more than three letters."""
    return F.when((F.length(w) > 3) & w.endswith("s"), w.substr(F.lit(1), F.length(w) - 1)).otherwise(w)


def name_tokens(c: Column) -> Column:
    """Distinct words of two letters or more, without the final s of longer ones."""
    return F.array_distinct(F.transform(F.filter(words(normalise(c, False, False)), lambda w: F.length(w) > 1), singular))


def coverage(a: Column, b: Column) -> Column:
    """The share of a's words of two letters or more that b has; repeated words count each time."""
    left = F.filter(words(normalise(a, False)), lambda w: F.length(w) > 1)
    right = words(normalise(b, False))
    return F.when(F.size(left) > 0, F.size(F.filter(left, lambda w: F.array_contains(right, w))) / F.size(left)).otherwise(F.lit(0.0))


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 0.8 at least if one of four letters or more begins the other."""
    longest = F.greatest(F.length(a), F.length(b))
    plain = F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)
    prefix = (F.least(F.length(a), F.length(b)) >= 4) & (a.startswith(b) | b.startswith(a))
    return F.when(prefix, F.greatest(plain, F.lit(0.8))).otherwise(plain)


def match_score(a: Column, b: Column) -> Column:
    """100 for equal names, 85 if one holds the other, 45 + 35 * share of common words if that is a half or more, else 0."""
    x, y = normalise(a, False, False), normalise(b, False, False)
    p, q = name_tokens(a), name_tokens(b)
    ratio = F.size(F.array_intersect(p, q)) / F.greatest(F.size(p), F.size(q), F.lit(1))
    score = F.when(x == y, 100).when(x.contains(y) | y.contains(x), 85).when(ratio >= 0.5, F.floor(45 + ratio * 35 + 0.5)).otherwise(0)
    return F.when((x == "") | (y == ""), 0).otherwise(score).cast("int")


def strip_markup(c: Column) -> Column:
    """Text of an HTML fragment: tags become blanks, the common entities their characters."""
    c = F.regexp_replace(c, "(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.regexp_replace(c, entity, char)
    return squeeze(c)


def html_lines(c: Column) -> Column:
    """Distinct non-empty lines of an HTML page, in order: scripts and styles go, block tags end lines."""
    c = F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    c = F.regexp_replace(c, r"(?i)</?(p|div|br|li|tr|td|th|h1|h2|h3|h4|h5|h6|ul|ol|table|section|article|header|footer|title)[^>]*>", "\n")
    lines = F.transform(F.split(c, "\n"), strip_markup)
    return F.array_distinct(F.filter(lines, lambda x: x != ""))


def clean_styles(c: Column, passes: int = 8) -> Column:
    """Text without style blocks and rules, removed again and again until nothing changes or passes are over."""
    for _ in range(passes):
        c = F.regexp_replace(c, r"[.#]?[a-zA-Z][a-zA-Z0-9_-]*\{[^{}]*\}", " ")
    return squeeze(c)


def search_query(c: Column, longest: int = 120) -> Column:
    """Letters, digits and a few marks, at most longest characters."""
    return F.trim(F.left(squeeze(F.regexp_replace(c, r"[^A-Za-z0-9&' .-]+", " ")), F.lit(longest)))


def upper_snake(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, "([a-z])([A-Z])", "$1_$2"))
