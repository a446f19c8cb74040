"""What a large group of near copies costs op2: pairs of sets don't pile up, and no link is lost."""

import random

import pytest

from basketry.llm import ngram_join


def near_copies(n: int) -> list[tuple[int, str]]:
    rng, rows = random.Random(5), []
    for i in range(n):
        words = [f"w{j}" for j in range(120)]
        for at in rng.sample(range(4, 116), (1, 1, 1, 2, 2, 2, 2, 3)[i % 8]):
            words[at] = f"x{i}"
        rows.append((i, " ".join(words)))
    return rows


def components(rows: list[tuple[int, str]]) -> dict[int, int]:
    """By brute force."""
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in rows}
    least = {i: i for i in sets}
    for i in sets:
        for j in range(i):
            if least[i] != least[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((least[i], least[j]))
                least = {k: a if v == b else v for k, v in least.items()}
    return least


def test_sets_that_stars_leave_apart_meet_few_of_a_large_component(spark, monkeypatch):
    compared, verified = [], ngram_join._verified
    monkeypatch.setattr(ngram_join, "_verified", lambda sets, pairs, limit: (compared.append(pairs.count()), verified(sets, pairs, limit))[1])
    docs = spark.createDataFrame(near_copies(1500), "doc_id long, text string").repartition(4)
    assert {r.component_id for r in ngram_join.join(docs).collect()} == {0}
    # 22,209 in one round, 3,162 in rounds; keys of hashes are drawn for each run
    assert sum(compared[2:]) < 12_000


@pytest.mark.parametrize("rounds", [(16, 4, 1), (2, 1), (1,)])
def test_rounds_lose_no_link(spark, monkeypatch, rounds):
    monkeypatch.setattr(ngram_join, "ROUNDS", rounds, raising=False)
    monkeypatch.setattr(ngram_join, "LARGE", 3, raising=False)
    # near copies of two texts, and texts with more changes that link with few or none of them
    rng = random.Random(8)
    rows = near_copies(120)
    for i in range(120, 200):
        words = [f"{'wv'[i % 2]}{j}" for j in range(120)]
        for at in rng.sample(range(4, 116), 1 + i % 5):
            words[at] = f"x{i}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.doc_id: r.component_id for r in ngram_join.join(docs).collect()} == components(rows)
