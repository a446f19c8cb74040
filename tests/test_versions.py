"""Guarded changes against a sequential replay."""

import random

import pytest

from basketry.operators.durable import cut
from basketry.operators.versions import guarded


@pytest.mark.parametrize(("seed", "blocks"), [(1, 1), (2, 4)])
def test_changes_are_a_replay(spark, seed, blocks):
    r = random.Random(seed)
    first = {k: r.choice("abc") for k in "pqr"}
    changes, of, told = [], {}, {}
    for at in range(150):
        key = r.choice("pppqrs")
        earlier = [a for a, _, _ in of.get(key, [])]
        if earlier and r.random() < 0.35:
            changes.append((key, at, None, None, r.choice([earlier[-1], r.choice(earlier), 999])))
        else:
            changes.append((key, at, r.choice(["a", "b", "c", None]), r.choice("abc"), None))
        of.setdefault(key, []).append((at, None, None))
    now, gives, accepted = dict(first), {}, set()
    for key, at, expected, value, undoes in changes:
        p, n = expected, value
        if undoes is not None:
            p, n = reversed(gives[undoes]) if undoes in gives else (None, None)
        gives[at] = (p, n)
        good = key in now and p is not None and n is not None and p == now[key] and (undoes is None or undoes in accepted)
        if good:
            now[key] = n
            accepted.add(at)
        told[at] = (p, n, good)
    rows = spark.createDataFrame(changes, "key string, at long, expected string, value string, undoes long").repartition(3)
    states = spark.createDataFrame(list(first.items()), "key string, value string")
    got = {x["at"]: (x["previous"], x["next"], x["accepted"]) for x in guarded(rows, states, cut, blocks=blocks).collect()}
    assert got == told
    assert any(told[c[1]][2] for c in changes if c[4] is not None)
    assert guarded(rows.limit(0), states, cut).collect() == []
