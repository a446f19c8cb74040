"""Words that a polynomial modulo 2**64 can't tell apart, in every operator whose result rests on hashes of words."""

import numpy as np
import pytest

from basketry.llm import decontam, ngram_join, substring_dedup
from basketry.llm import textscan as ts


def sequence(bits: int) -> tuple[str, str]:
    """The Thue-Morse word of 2**bits letters and its complement: their difference divides by every b**(2**i) - 1."""
    word = "a"
    for _ in range(bits):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


X, Y = sequence(11)


def spans(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(r) + 1 for r in raw]) - 1
    return np.frombuffer(b" ".join(raw), np.uint8), ends - [len(r) for r in raw], ends


def test_words():
    a, b, c = ts.word_hashes(*spans([X, Y, X]), key=3).tolist()
    assert a == c != b
    assert ts.word_hashes(*spans([X]), key=4)[0] != a
    long = "ab" * ts.SEGMENT
    a, b, c = ts.word_hashes(*spans([long, "x", long])).tolist()
    assert a == c != b
    a, b = ts.word_hashes(*spans([long + "a", long + "b"])).tolist()
    assert a != b


@pytest.mark.parametrize("width", [1, 2, 3, 5, 35, 64, 1000])
def test_runs(width):
    values = np.random.default_rng(1).integers(0, 3, 3000).astype(np.uint64)
    hashes = ts.sequence_hashes(values, width, 9)
    assert len(hashes) == 3000 - width + 1
    of: dict[bytes, int] = {}
    for i, h in enumerate(hashes.tolist()):
        assert of.setdefault(values[i : i + width].tobytes(), h) == h
    assert len(set(of.values())) == len(of)
    low = np.array([int(c == "a") for c in X], np.uint64)
    one, two = ts.sequence_hashes(low, len(X)), ts.sequence_hashes(np.uint64(1) - low, len(X))
    assert one[0] != two[0]


def test_long_words_are_told_apart(spark):
    rest = " ".join(f"w{i}" for i in range(34))
    docs = spark.createDataFrame([(1, f"{X} {rest}"), (2, f"{Y} {rest}")], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in substring_dedup.digests(docs).collect()} == {1: 0, 2: 0}
    docs = spark.createDataFrame([(1, f"{X} q r s t"), (2, f"{Y} q r s t"), (3, f"{X} q r s t")], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.join(docs).collect()} == {1: 1, 2: 2, 3: 1}
    one, two = (decontam.grams(decontam.terms([f"{w} b c d e f g h i j k l m"])[0]) for w in (X, Y))
    assert len(np.intersect1d(one, one)) == len(np.intersect1d(one, two)) + 1


def test_large_sets_near_each_other(spark):
    """Sets whose beginnings of rare elements are longer than what a row carries of them."""
    rng = np.random.default_rng(5)
    body = [f"w{i}" for i in rng.integers(0, 1 << 40, 20_000)]
    rows = []
    for doc in range(14):
        words = list(body)
        for at in rng.choice(len(words), 400, replace=False):
            words[at] = f"x{doc}_{at}"
        rows.append((doc, " ".join(words)))
    found = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"), threshold=0.75).collect()

    def grams(text: str) -> set:
        w = text.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets = [grams(t) for _, t in rows]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b]):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if x == old else x for x in label]
    assert {r["doc_id"]: r["component_id"] for r in found} == dict(enumerate(label))
