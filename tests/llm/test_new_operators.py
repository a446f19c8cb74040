"""HTML extraction, centroid clustering and spelling variants against brute force, planted cases and held-out pages."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from basketry.llm import centroids, dom, extraction, labelled_pages, spelling

# ---- extraction


def read(source: str) -> str:
    page = dom.parse(source)
    return dom.joined(page, [True] * len(page.texts))


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("<p><b>Hi<br><p>To &amp; x &am", "Hi To & x &am"),
        ("a<b>b</b>c <i>d</i>", "abc d"),
        ("<ul><li>a<li>b</ul>c", "a b c"),
        ('<div>x<script>var t="</p>";a<b</script>y</div>', "xy"),
        ("<!-- a <p> -->z<!-->q", "zq"),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "1 2 3"),
        ("<b><p>x</b>y</p>z", "xy z"),
        ('x<a href="q>1">l</a> < 5 &lt;b&gt; &#x41;&#66;', "xl < 5 <b> AB"),
        ('<a title="', ""),
        ("<p>one<span class=ad>two</span>three", "onetwothree"),
        ("<head><title>x</title><p>q", "q"),
        ("<head>text", "text"),
        ("<select><option>1</select>z<textarea><p></textarea>", "z"),
        ("<p>a&nbsp;\n b</p>\n<p> </p>", "a b"),
        ("", ""),
        ("<", "<"),
    ],
)
def test_blocks(source, text):
    assert read(source) == text


@pytest.mark.parametrize("source", ["<div>" * 50_000 + "x", "<p>" * 50_000 + "x", "<b class=q>" * 20_000 + "x" + "</i></b>" * 20_000, "<" * 300_000 + "x", '<a b="' * 100_000, "<!--" * 100_000, "<a " * 100_000])
def test_broken_pages_take_linear_time(source):
    assert read(source).replace("<", "") in ("x", "")


@pytest.fixture(scope="module")
def model():
    return extraction.composed()


def test_held_out_pages(model):
    held = labelled_pages.pages(200, seed=99)
    found = extraction.texts(model, [s for s, _ in held])
    right = wrong = missed = 0
    for text, (_, main) in zip(found, held, strict=True):
        a, b = Counter(text.split()), Counter(main.split())
        both = sum((a & b).values())
        right, wrong, missed = right + both, wrong + sum(a.values()) - both, missed + sum(b.values()) - both
    assert right / (right + wrong) > 0.96
    assert right / (right + missed) > 0.96


def test_parts_that_are_no_article(model):
    said = [f"The harbour stayed open all winter, said officer {i}. Ships kept coming in, though the ice was thick and the nights were long, and nobody on the quay complained." for i in range(10)]
    body = "".join(f"<p>{p}</p>" for p in said)
    page = f"""<html><body><div class="cookie-banner"><p>This site keeps small files on your machine. Do you agree?</p></div>
<header><p>The Daily Harbour, since 1901.</p></header><nav><a href=a>Start</a> <a href=b>Ships</a></nav>
<div class="article-body"><h1>Winter</h1>{body}<div class="ad-slot"><p>Buy our boats today, they float.</p></div></div>
<aside class="sidebar"><h3>Most read</h3><p><a href=x>Ten storms that nobody will forget</a></p></aside>
<form action=s><label>Search this site</label><input></form>
<section id="comments"><h3>Readers say</h3><div class="comment"><p>I was there and it was cold indeed.</p></div></section>
<footer>&copy; 2020 The Daily Harbour. All rights reserved.</footer></body></html>"""
    want = " ".join(["Winter", *said])
    assert extraction.texts(model, [page]) == [want]


def brute_marginals(model, f) -> np.ndarray:
    """Marginals by adding up all labellings."""
    n = len(f.parent)
    own = np.bincount(f.owner, weights=model.weights[f.features], minlength=n)
    total, on = 0.0, np.zeros(n)
    for bits in range(1 << n):
        y = [(bits >> i) & 1 for i in range(n)]
        score = sum(own[i] * y[i] for i in range(n)) + sum(model.pairs[f.kind[i], y[f.parent[i]], y[i]] for i in range(n) if f.parent[i] >= 0)
        w = math.exp(score)
        total += w
        on += w * np.array(y)
    return on / total


def test_messages_are_exact(model):
    page = dom.parse("<div><p>One two.</p><ul><li>a<li><a href=x>b</a></ul></div><footer>c</footer>")
    f = extraction.forest([page])
    assert np.allclose(model.marginals(f), brute_marginals(model, f))


def test_training_slope_is_seen_minus_expected():
    pages = labelled_pages.pages(30)
    few, many = extraction.fit(pages, steps=5), extraction.fit(pages, steps=60)
    parsed = [dom.parse(s) for s, _ in pages]
    f = extraction.forest(parsed)
    truth = np.concatenate([extraction.labels(p, m) for p, (_, m) in zip(parsed, pages, strict=True)])
    rate = [((m.marginals(f) >= 0.5) == truth).mean() for m in (few, many)]
    assert rate[1] > 0.97
    assert rate[1] >= rate[0]
    assert np.array_equal(extraction.fit(pages, steps=5).weights, few.weights)


def test_extract_edges(spark, model):
    rows = [(1, None, "k", 0), (2, "", "k", 1), (3, "<p>" + "Long words go on and on. " * 120_000 + "</p>", "k", 2), (4, "no tags at all, but a sentence.", "k", 3), (4, "no tags at all, but a sentence.", "k", 3)]
    df = spark.createDataFrame(rows, "page_id long, html string, text string, __source int")
    found = extraction.extract(df, model).repartition(3)
    assert set(found.columns) == {"page_id", "html", "text", "__source"}
    texts = sorted((r["page_id"], r["text"]) for r in found.collect())
    assert [p for p, _ in texts] == [1, 2, 3, 4, 4]
    assert texts[0][1] == texts[1][1] == ""
    assert texts[3] == texts[4]
    assert len(texts[2][1]) in (0, 25 * 120_000 - 1)
    assert extraction.extract(df.limit(0), model).count() == 0


# ---- clustering


def brute_clusters(rows, k=40, rounds=5):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(256 * x) for x in v]))
    if not kept:
        return []
    centres = [q for _, _, q in sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), j, q) for j, (i, q) in enumerate(kept))[:k]]

    def assign():
        out = []
        for i, q in kept:
            out.append((i, *min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), n) for n, c in enumerate(centres)), q))
        return out

    for _ in range(rounds):
        now = assign()
        for n in range(len(centres)):
            mine = [q for _, _, c, q in now if c == n]
            if mine:
                centres[n] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    now = assign()
    each = Counter()
    for _, d, c, _ in now:
        each[c] += d
    return sorted((i, c, d, each[c], sum(each.values()), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for i, d, c, _ in now)


def grouped(seed: int, n: int) -> list:
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, 64)) * 3
    return [(i, (centres[r.integers(12)] + r.normal(size=64) * 0.3).astype(np.float32).tolist()) for i in range(n)]


def test_clusters_are_brute_force(spark):
    rows = grouped(1, 300)
    # copies, ties, and vectors that take no part
    rows += [(1000 + i, rows[3][1]) for i in range(60)] + [(2000, None), (2001, [1.0] * 63), (2002, [float("nan")] * 64), (2003, [None] + [1.0] * 63), (2004, [float("inf")] * 64), (2005, []), (2006, [0.0] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = brute_clusters(rows)
    for parts in (1, 7):
        found = centroids.cluster(df.repartition(parts))
        assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
        assert sorted(map(tuple, found.collect())) == want


def test_large_numbers_and_few_vectors(spark):
    rows = [(i, [float((i + 1) * 2.0**20 * (-1) ** (i + j)) for j in range(64)]) for i in range(5)]
    assert sorted(map(tuple, centroids.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())) == brute_clusters(rows)
    huge = [(0, [1e30] * 64), (1, [-1e30] * 64), (2, [3.0] * 64)]
    found = {r["vec_id"]: r for r in centroids.cluster(spark.createDataFrame(huge, "vec_id long, embedding array<double>"), k=1).collect()}
    centre = sum(math.floor(256 * v[0]) for _, v in huge) // 3
    assert found[2]["centroid_sha256"] == hashlib.sha256(",".join([str(centre)] * 64).encode()).hexdigest()
    assert found[0]["distance"] == found[0]["inertia"] == 2**63 - 1
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert centroids.cluster(df).collect() == []
    one = centroids.cluster(spark.createDataFrame([(None, [1.0] * 64)], "vec_id long, embedding array<float>")).collect()
    assert [(r["vec_id"], r["cluster"], r["distance"]) for r in one] == [(None, 0, 0)]


def test_screening_spares_distances():
    values = np.array([[math.floor(256 * x) for x in v] for _, v in grouped(2, 2000)])
    screen = centroids.Screen(values[:40].tolist())
    at, best, exact = screen.nearest(values, centroids.compressed(values))
    every = ((values[:, None, :] - values[None, :40, :]) ** 2).sum(axis=2)
    assert np.array_equal(best, every.min(axis=1))
    assert np.array_equal(at, every.argmin(axis=1))
    assert exact < 0.3 * every.size


def test_bounds_never_exceed_distances():
    r = np.random.default_rng(3)
    for scale in (1, 1e3, 1e6):
        a, b = (np.floor(r.normal(size=(500, 64)) * scale) for _ in range(2))
        low = np.square(centroids.compressed(a) - centroids.compressed(b)).sum(axis=1)
        assert (low <= np.square(a - b).sum(axis=1) * (1 + 1e-9)).all()


# ---- spelling


def one_apart(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


@pytest.mark.parametrize("letters", ["ab", "abcé", "aÿ×"])
def test_walks_are_brute_force(letters, monkeypatch):
    r = random.Random(7)
    known = sorted({"".join(r.choice(letters) for _ in range(r.randint(0, 7))) for _ in range(400)})
    asked = [*known, "", "z" * 5, "a" * 40]
    for block in (1 << 17, 50):
        monkeypatch.setattr(spelling, "BLOCK", block)
        of, entry = spelling.Trie(known, [1] * len(known)).near(asked)
        found = sorted(zip(of.tolist(), entry.tolist(), strict=True))
        assert len(set(found)) == len(found)
        assert found == [(i, j) for i, a in enumerate(asked) for j, b in enumerate(known) if one_apart(a, b)]
    assert all(len(x) == 0 for x in spelling.Trie([], []).near(asked))


def brute_variants(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    out, forms = [], {}
    near = {w: [v for v in n if one_apart(w, v)] for w in n}
    for w, some in near.items():
        best = min(some, key=lambda v: (-n[v], v), default=None)
        forms[w] = best if best is not None and n[best] >= 5 * n[w] else None
    for w in n:
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.append((w, forms[w], root, n[w], len(near[w]), n[forms[w]] if forms[w] else None))
    return sorted(out)


@pytest.mark.parametrize("letters", [spelling.SHARD_LETTERS, 300])
def test_variants_are_brute_force(spark, monkeypatch, letters):
    monkeypatch.setattr(spelling, "SHARD_LETTERS", letters)
    monkeypatch.setattr(spelling, "GROUP_BYTES", 4000 if letters < 1000 else spelling.GROUP_BYTES)
    r = random.Random(4)
    stems = ["".join(r.choice("aeiourstln") for _ in range(r.randint(5, 9))) for _ in range(25)] + ["straße", "élèves", "a" * 700]
    pool = []
    for i, s in enumerate(stems):
        pool += [s] * (600 if i < 4 else 40)
        for k in range(6):
            at = r.randrange(len(s))
            pool += [s[:at] + r.choice(["", s[at] * 2, "x"]) + s[at + 1 :]] * r.choice([5, 8, 30])
            pool += [s[:at] + "x" + s[at + 1 :] + "x"] * r.choice([5, 1])
    rows = [(i % 90 if i % 91 else None, " ".join(r.choice([w, w.upper()]) for w in r.sample(pool, 60))) for i in range(400)] + [(500, None), (501, ""), (502, "1 2, ."), (7, "Straße-straße"), (7, "Straße-straße")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, spelling.group(df).collect()), key=str) == sorted(brute_variants(rows), key=str)


def test_no_words(spark):
    df = spark.createDataFrame([(1, None), (2, "short")], "doc_id long, text string")
    found = spelling.group(df)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert found.collect() == []
    assert spelling.group(df.limit(0)).collect() == []
