"""Readers: strict and annotated CSV, records within JSON, HTML and XML, and lines of recognised pages."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def strict_csv(spark: SparkSession, path: str, schema: str, key: str | None = None, least: int = 1) -> DataFrame:
    """Rows of CSV files whose headers must equal the schema's names, in order, in every file; a malformed row (too few or too many
    fields, a value of another type, a quote that isn't closed), too few rows or a repeated key fail.

    The checks on all rows are two aggregations; only their counts come to the driver.
    """
    wanted = StructType.fromDDL(schema)
    lines = spark.read.text(path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    if not lines.filter(quotes % 2 == 1).isEmpty():
        raise ValueError("a quote isn't closed")
    raw = spark.read.option("header", False).option("escape", '"').schema(", ".join(f"`{c}` string" for c in [*wanted.names, "__more"])).csv(path)
    heading = F.lit(True)
    for c in wanted.names:
        heading = heading & F.coalesce(F.col(f"`{c}`") == c, F.lit(False))
    of_file = raw.groupBy(F.input_file_name().alias("file")).agg(F.count_if(heading).alias("n"))
    wrong = of_file.filter("n <> 1").select("file").first()
    if wrong or not any(of_file.take(1)):
        raise ValueError(f"header isn't {wanted.names}" + (f" in {wrong['file']}" if wrong else ""))
    rows = spark.read.option("header", True).option("enforceSchema", False).option("escape", '"').option("mode", "FAILFAST").schema(wanted).csv(path)
    # a hash of all columns: a count alone would read none, and so see no malformed row
    try:
        n = rows.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*[F.col(f"`{c}`") for c in wanted.names])).alias("h")).first()["n"]
    except Exception as e:
        raise ValueError(f"a row is malformed: {str(e)[:300]}") from e
    if n < least:
        raise ValueError(f"{n} rows, at least {least} are needed")
    if key and not rows.groupBy(key).count().filter("count > 1").isEmpty():
        raise ValueError(f"{key} repeats")
    return rows


def annotated_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rows of a CSV file with annotation lines (#) and headers that repeat; rows of another length are dropped, values are strings."""
    rows = spark.read.option("comment", "#").option("escape", '"').option("mode", "DROPMALFORMED").schema(", ".join(f"`{c}` string" for c in columns)).csv(path)
    header = F.lit(True)
    for c in columns:
        header = header & F.coalesce(F.col(c) == c, F.lit(False))
    return rows.filter(~header)


def first_of(doc: Column, *paths: str) -> Column:
    """The first of the JSON paths that holds a value other than an empty text."""
    return F.coalesce(*[F.nullif(F.trim(F.get_json_object(doc, p)), F.lit("")) for p in paths])


def _nodes(wanted: Callable[[dict], bool]):
    """A function that lists, as JSON, the objects at any depth of a JSON text that are wanted; none where it isn't JSON."""

    def found(text: str | None) -> list[str]:
        try:
            open_, out = [json.loads(text or "null")], []
        except ValueError:
            return []
        while open_:
            x = open_.pop()
            if isinstance(x, dict):
                if wanted(x):
                    out.append(json.dumps(x))
                open_.extend(reversed(list(x.values())))
            elif isinstance(x, list):
                open_.extend(reversed(x))
        return out

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(found)

    return run


def objects_with(doc: Column, *keys: str) -> Column:
    """The objects at any depth of a JSON text that have all the keys."""
    return _nodes(lambda x: all(x.get(k) is not None for k in keys))(doc)


def embedded_objects(html: Column, kind: str) -> Column:
    """Objects of an @type, at any depth, in the JSON-LD blocks of a page."""
    blocks = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))
    listed = F.concat(F.lit("["), F.array_join(F.filter(blocks, lambda b: F.try_parse_json(b).isNotNull()), ","), F.lit("]"))

    def is_kind(x: dict) -> bool:
        t = x.get("@type")
        return kind in t if isinstance(t, list) else t == kind

    return _nodes(is_kind)(listed)


def page_data(html: Column, schema: str, block: str = "__NEXT_DATA__") -> Column:
    """The JSON that a page carries in the script of an id, by a schema; null where it has none or another form."""
    text = F.regexp_extract(F.coalesce(html, F.lit("")), rf'(?is)<script[^>]*id="{block}"[^>]*>(.*?)</script>', 1)
    return F.from_json(F.nullif(text, F.lit("")), schema)


def xml_rows(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """An XML file's elements of a tag, prefixes of names ignored."""
    return spark.read.format("xml").option("rowTag", tag).option("ignoreNamespace", True).schema(schema).load(path)


def recognised_lines(pages: DataFrame, blocks: str = "blocks") -> DataFrame:
    """Lines of pages (blocks: array of struct of paragraphs: array of struct of lines: array), with their place, blanks dropped."""
    lines = F.flatten(F.transform(F.flatten(F.transform(F.col(blocks), lambda b: b["paragraphs"])), lambda p: p["lines"]))
    return pages.select(*[c for c in pages.columns if c != blocks], F.posexplode(F.filter(lines, lambda x: F.trim(x) != "")).alias("line", "text"))
