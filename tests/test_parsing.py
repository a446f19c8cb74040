"""Receipts read line by line: against a plain state machine and known receipts."""

import random

from pyspark.sql import functions as F

from basketry.functions import parsing as P
from basketry.operators import sequence as S


def rows(spark, *receipts):
    return spark.createDataFrame([(r, i, line) for r, text in enumerate(receipts) for i, line in enumerate(text.split("\n"))], "r long, num long, line string").repartition(4)


def read(spark, text):
    return [tuple(x)[2:] for x in P.purchases(rows(spark, text), "r", "num", "line").orderBy("place").collect()]


# A receipt that is known.
COLES = """Coles Supermarkets Australia Pty Ltd
Tax Invoice ABN: 45 004 189 708
Date: 09/08/2026 Time: 14:20
Description $
% PEPSI MAX COLA 1.25LITRE 16.00
4 @ $4.00 EACH
COLES SUGAR RAW 2KG 3.20
%DARE ESPRESSO 750ML 4.50
%ICE BREAK ICED COFFEE 500ML 2.90
%MILKYBAR CHOC BLOCK 170GRAM 3.75
%KITKAT COOKIE DOUGH 170GRAM 3.75
%KIT KAT CHUNKY AERO 155GRAM 4.19
HAWAIIAN PIZZA SCROL 2PACK 3.75
Total for 11 items: $35.60
EFT $25.00
EFT $10.60"""


def test_known_receipts(spark):
    found = read(spark, COLES)
    assert len(found) == 8
    assert found[0] == ("PEPSI MAX COLA 1 25LITRE", 4.0, 16.0, 98)
    assert found[6] == ("KIT KAT CHUNKY AERO 155GRAM", 1.0, 4.19, 96)
    assert sum(q for _, q, _, _ in found) == 11
    assert read(spark, "Unknown Market\nDescription\nCOLA 4.00\n3 @ $1.00 EACH\nTOTAL $4.00") == [("COLA", 3.0, 3.0, 98)]
    photo = "Woolworths\nDescription\n#Pepsi Max Cola Drink 1.25L\nQty 3 @ $2.25 each 6.75\n#KitKat Cookie Dough Block 170g 5.00\n#KitKat Aero Mint Block 155g\n5.00\n5 SUBTOTAL $16.75\nTOTAL $16.75\nLate 1.00"
    assert read(spark, photo) == [("Pepsi Max Cola Drink 1 25L", 3.0, 6.75, 98), ("KitKat Cookie Dough Block 170g", 1.0, 5.0, 96), ("KitKat Aero Mint Block 155g", 1.0, 5.0, 96), ("5 SUBTOTAL", 1.0, 16.75, 96)]


def test_descriptions_that_wait(spark):
    head = "Description\n"
    assert read(spark, head + "Milk\nBread\n2 @ 1.50") == [("Bread", 2.0, 3.0, 98)]
    # what isn't a description waits on, and is given up by a quantity
    assert read(spark, head + "Milk\nSUBTOTAL 9.00\n3.00") == [("Milk", 1.0, 3.0, 96)]
    assert read(spark, head + "M\n3.00\nMilk 1.00\n2 @ 4.00") == [("Milk", 2.0, 8.0, 98)]
    assert read(spark, head + "M\n2 @ 4.00\nMilk 1.00") == [("Milk", 1.0, 1.0, 96)]
    assert read(spark, head + "2 @ 4.00\n3.00") == []
    assert read(spark, head + "Milk 1.00\n2 @ 4.00\n3 @ 4.00") == [("Milk", 3.0, 12.0, 98)]
    assert read(spark, head + "Milk\n1.00\n2.00") == [("Milk", 1.0, 1.0, 96)]
    assert read(spark, "no heading\nMilk 1.00") == []
    assert read(spark, "") == []


def test_null_and_repeated_lines(spark):
    df = spark.createDataFrame([(1, 0, "Description"), (1, 1, None), (1, 2, "Milk 1.00"), (1, 2, "Milk 1.00"), (None, 0, "Description"), (None, 1, "Tea 2.00")], "r long, num long, line string")
    found = sorted(map(tuple, P.purchases(df, "r", "num", "line").collect()), key=str)
    assert found == [(1, 1, "Milk", 1.0, 1.0, 96), (1, 2, "Milk", 1.0, 1.0, 96), (None, 1, "Tea", 1.0, 2.0, 96)]
    assert P.purchases(df.limit(0), "r", "num", "line").collect() == []


def test_carried_is_a_fold(spark):
    r = random.Random(2)
    data = [(k, i, r.choice([None, None, "a", "b", ""]), r.random() < 0.3) for k in range(20) for i in range(r.randint(0, 60))]
    df = spark.createDataFrame(data, "k long, i long, v string, shut boolean").repartition(5)
    found = {(x["k"], x["i"]): x["out"] for x in S.carried(df, ["k"], [F.col("i")], F.col("v"), lambda _: F.col("shut"), "out").collect()}
    for k in range(20):
        now = None
        for _, i, v, shut in sorted(x for x in data if x[0] == k):
            assert found[k, i] == now
            now = v if v is not None else None if shut else now


def test_regions(spark):
    def at(text):
        x = P.regions(rows(spark, text), "r", "num", "line").collect()[0]
        return x["start"], x["end"], x["mark"]

    assert at(COLES) == (4, 13, "heading")
    # a price in the head that no merchandise follows isn't the first product; packs right before it are
    text = "ABN 89.70\nJunk 89.70\nhello\nthere\nagain\nCat Litter 15kg\nMilk 2L\nBread 3.00\nButter 4.00\nTOTAL 7.00\nVISA 7.00"
    assert at(text) == (5, 9, "merchandise")
    assert at("Woolworths\nPOS 065 TRANS 2646\nMilk 3.00\nTOTAL\n3.00") == (2, 3, "transaction")
    assert at("Milk 3.00\nTea 2.00\n2 items\n$5.00") == (0, 2, "merchandise")
    assert at("a 1kg\nb 1kg\nc 1kg\ndd 1kg\nMilk 3.00\n2 @ 1.50\nTOTAL\nVISA 3.00") == (4, 8, "merchandise")
    assert at("aaa 1kg\nbbb 1kg\nccc 1kg\nddd 1kg\nMilk 3.00\n2 @ 1.50") == (1, 6, "merchandise")
    assert at("hello\nthere") == (2, 2, "none")
