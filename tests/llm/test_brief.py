"""op2 compares a byte an element before it sends sets: no link is lost by that, and few sets are sent."""

import random

import numpy as np

from basketry.llm import ngram_join


def test_places_give_no_less_in_common_than_there_is():
    rng = np.random.default_rng(4)
    for size in (1, 2, 3, 40, 63, 64, 65, 700, 9000):
        for other in {size, max(1, size * 3 // 4), size + size // 3}:
            for common in {0, min(size, other) // 2, min(size, other)}:
                drawn = rng.integers(0, 2**64, size + other, dtype=np.uint64)
                one, two = drawn[:size], np.concatenate([drawn[:common], drawn[size : size + other - common]])
                raw = [np.frombuffer(ngram_join.brief(np.sort(x)), np.uint8) for x in (one, two)]
                told = [ngram_join.places(x) for x in raw]
                assert [len(x) for x in told] == [size, other] and all(len(x) <= 1.5 * n + 200 for x, n in zip(raw, (size, other), strict=True))
                total, most = ngram_join.most_common(*told)
                assert total == size + other and common <= most <= common + 3 + 0.06 * total


def test_pairs_short_of_the_threshold_and_within_a_component_are_not_sent_whole(spark, monkeypatch):
    sent, compared = {}, ngram_join._compared
    monkeypatch.setattr(ngram_join, "_compared", lambda sets, pairs, column, reaches: (sent.update({column: sent.get(column, 0) + pairs.count()}), compared(sets, pairs, column, reaches))[1])
    rng = random.Random(2)
    sets, pairs = [], []
    for group in range(10):
        base = [rng.randrange(2**63) for _ in range(300)]
        # eight sets that link with each other, and eight that share two thirds with these
        for i in range(16):
            own = base[: 295 if i < 8 else 230]
            elements = np.sort(np.array(own + [rng.randrange(2**63) for _ in range(300 - len(own))], np.uint64))
            sets.append((group * 16 + i, 300, elements.tobytes(), ngram_join.brief(elements)))
            pairs += [(group * 16 + j, group * 16 + i) for j in range(i)]
    known = spark.createDataFrame([(*s[:2], bytearray(s[2]), bytearray(s[3])) for s in sets], "name long, size int, elements binary, brief binary")
    links = ngram_join._verified(known, spark.createDataFrame(pairs, "x long, y long"), ngram_join.Fraction(3, 4)).collect()
    assert {(r.x // 16, r.y % 16) for r in links} == {(g, i) for g in range(10) for i in range(1, 8)} and all(r.x % 16 < 8 for r in links)
    # 1,200 pairs, 280 of them links; 70 join all
    assert sent["brief"] == 1200 and sent["elements"] == 70
