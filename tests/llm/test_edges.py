"""Edges of all text operators: nulls, empty tables, long texts, ties, repeated rows, keys and columns of other kinds, and other partitionings."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.llm import bpe, chat, common, decontam, ngram_join, permutation_index, quality, substring_dedup, suffix_dedup, textscan, toxicity, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def coding():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def odd(spark):
    """String keys, and columns named like those that the operators might use themselves."""
    rng = np.random.default_rng(4)
    base = " ".join(rng.choice([f"w{i}" for i in range(50)], 90))
    texts = [base, base, base + " tail", None, "", "one two", base.replace("w1 ", "W1 ", 1)]
    names = ["__text", "__key", "__spans", "__hash", "__set", "__n", "__k", "__leaks", "__score", "name", "bucket", "k", "t"]
    rows = [(f"d{i}", t, *[f"{c}{i}" for c in names]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id string, text string, " + ", ".join(f"`{c}` string" for c in names))


def others(df):
    return sorted(tuple(r) for r in df.select(*[c for c in df.columns if c not in ("text", "leaks", "score", "ids")]).collect())


def test_columns_stay_whatever_their_names(spark, odd, coding):
    item = spark.createDataFrame([(1, "a question of words?\nan answer of words")], "item_id long, text string")
    model, lexicon = quality.Model(np.zeros(1 << quality.BITS), 0.0), toxicity.Lexicon({t: 3.0 for t in toxicity.GIVEN}, {})
    made = [substring_dedup.remove(odd), quality.score(odd, model), toxicity.score(odd, lexicon), decontam.matches(odd, item), bpe.encode(odd, *coding)]
    for got in made:
        assert others(got) == others(odd)
    kept = ngram_join.deduplicate(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == ["d0", "d3", "d4", "d5"]
    assert {r.doc_id: r.component_id for r in ngram_join.join(odd).collect()} == {"d0": "d0", "d1": "d0", "d2": "d0", "d3": "d3", "d4": "d4", "d5": "d5", "d6": "d0"}
    assert {r.doc_id for r in suffix_dedup.digests(odd).filter("n_removed > 0").collect()} == {"d0", "d1", "d2", "d6"}
    assert bpe.digests(odd, *coding).count() == substring_dedup.digests(odd).count() == 7


def test_classifiers_take_other_keys_labels_and_repeats(spark):
    rows = [(f"k{i}", ("good plain words " if i % 2 else "zzq xqz qqx ") * 3) for i in range(40)]
    docs = spark.createDataFrame(rows + rows[:5] + [("k0", "another text")], "doc_id string, text string")
    labels = spark.createDataFrame([(f"k{i}", i % 2, i % 2) for i in range(40)] + [("k1", 7, None), ("k0", 1, 0)], "doc_id string, quality int, toxic int")
    scores = [sorted((r.doc_id, round(r.score, 9)) for r in quality.score(docs, quality.fit(quality.sample(d, labels, "quality"))).collect()) for d in (docs, docs.repartition(7))]
    assert scores[0] == scores[1] and len(scores[0]) == 46
    lexicons = [toxicity.learn(toxicity.sample(d, labels, "toxic")) for d in (docs.coalesce(1), docs.repartition(12))]
    assert lexicons[0].terms == lexicons[1].terms and lexicons[0].beginnings == lexicons[1].beginnings and np.allclose(lexicons[0].layer, lexicons[1].layer)


def test_counts_of_terms_do_not_depend_on_partitions(spark):
    rows = [(i, int(i % 3 == 0), f"alpha beta{'x' * (i % 2)} gamma" + (" " + "long" * 30 if i % 4 == 0 else "")) for i in range(24)]
    df = spark.createDataFrame(rows, "__k long, __y int, __text string")
    one, many = (sorted(map(tuple, toxicity._counted(d).collect())) for d in (df.coalesce(1), df.repartition(12)))
    assert one == many and any(len(t) > 100 for t, _, _ in one)


def test_words_are_read_whole(spark):
    matcher = toxicity.Matcher(toxicity.Lexicon({"moron" * 15: 3.0, "idiot": 3.0}, {}))
    texts = ["あ" * 40 + "idiot", "moron" * 15, "idiot" + "x" * 80]
    body = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    assert (toxicity.windows(body, offsets, matcher)[:, 1] > 0).tolist() == [False, True, False]


def test_empty_tables(spark, coding):
    docs, none = spark.createDataFrame([], DOCS), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c"), (2, None)], DOCS)
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ngram_join.join(docs).collect() == ngram_join.deduplicate(docs).collect() == bpe.digests(docs, *coding).collect() == []
    assert substring_dedup.digests(docs).collect() == substring_dedup.remove(docs).collect() == suffix_dedup.digests(docs).collect() == []
    assert permutation_index.nearest(vectors, vectors).collect() == []
    assert decontam.matches(docs, none).collect() == [] and [r.leaks for r in decontam.matches(some, none).collect()] == [[], []]
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    lexicon = toxicity.learn(toxicity.sample(docs, labels, "toxic"))
    assert len({r.score for r in toxicity.score(some, lexicon).collect()}) == 1 and toxicity.score(docs, lexicon).collect() == []
    assert chat.digests(chat.format_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).collect() == []
    path = common.shared_dir(spark)
    warc.archive(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_pages(spark, path).collect() == []


def test_long_texts(spark, coding):
    """Texts of several segments and batches, with repeats that cross their borders."""
    rng = np.random.default_rng(6)
    vocabulary = np.array([f"word{i}" for i in range(3000)])
    long = " ".join(rng.choice(vocabulary, 400_000))
    assert len(long) > 2 << 20 > textscan.SEGMENT
    words = long.split(" ")
    cut = long[textscan.SEGMENT - 5000 : textscan.SEGMENT + 5000]
    rows = [(1, long), (2, "head " + " ".join(words[120_000:120_200]) + " tail"), (3, cut), (4, "é" * 300_000), (5, None)]
    docs = spark.createDataFrame(rows, DOCS)
    told = []
    texts = {i: WORD.findall(t or "") for i, t in rows}
    seen = Counter(" ".join(w[k : k + 35]) for w in texts.values() for k in range(len(w) - 34))
    for i, w in texts.items():
        gone = np.zeros(len(w) + 1, int)
        for k in range(len(w) - 34):
            if seen[" ".join(w[k : k + 35])] > 1:
                gone[k] += 1
                gone[k + 35] -= 1
        gone = np.cumsum(gone) > 0
        told.append((i, len(w), int(gone.sum()), hashlib.sha256(" ".join(x for x, g in zip(w, gone[:-1], strict=True) if not g).encode()).hexdigest()))
    assert sorted(map(tuple, substring_dedup.digests(docs).collect())) == told and told[0][2] > 1000
    got = {r.doc_id: r for r in suffix_dedup.digests(docs).collect()}
    at, body = long.encode().find(cut.encode()), long.encode()
    part = " ".join(words[120_000:120_200])
    low = body.find(part.encode())
    # the second text's part is repeated, with what by chance goes on alike
    assert got[3].n_removed == len(cut) and got[1].n_removed >= len(cut) + len(part) and got[2].n_removed >= len(part) and at >= 0 and low >= 0
    assert got[4].n_removed == 600_000 and got[4].n_spans == 1 and got[5].n_bytes == 0
    sizes = {r.doc_id: r.n_shingles for r in ngram_join.join(docs).collect()}
    assert sizes[1] == len({tuple(words[k : k + 5]) for k in range(len(words) - 4)}) and sizes[4] == 1 and sizes[5] == 0
    codec = bpe.codec(*coding)
    piece = long[:700_000] + " " * 50_000 + "12345" * 30_000
    assert codec.encode(long[:700_000]) == codec.encoding.encode_ordinary(long[:700_000])
    assert codec.decode(codec.encode(piece)) == piece.encode()
    pages = spark.createDataFrame([(1, "u", long), (2, "u", long), (3, "u", long[:99])], "page_id long, url string, html string")
    path = common.shared_dir(spark)
    warc.archive(pages, path)
    back = sorted(tuple(r) for r in warc.read_pages(spark, path).collect())
    digest = hashlib.sha256(body).hexdigest()
    assert back[:2] == [(1, len(body), digest, "response", None), (2, len(body), digest, "revisit", 1)]


def test_repeated_rows(spark, coding):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (1, "other"), (None, "a b c d e f")], DOCS)
    assert sorted(map(str, ngram_join.join(docs).collect())) == sorted(map(str, [(r.doc_id, 2 if r.text != "other" else 1, 1) for r in docs.collect()])) or {r.component_id for r in ngram_join.join(docs).collect()} == {1}
    assert sorted(str(r.text) for r in ngram_join.deduplicate(docs).collect()) == ["a b c d e f", "other"]
    assert bpe.digests(docs, *coding).count() == 4
    item = "What is the tallest hill of the northern valley called?\nIt is called the silver comb."
    items = spark.createDataFrame([(1, item), (1, item), (2, item), (3, None), (4, " ")], "item_id long, text string")
    got = decontam.matches(spark.createDataFrame([(1, "x " * 50 + item), (1, "x " * 50 + item), (2, "x")], DOCS), items).collect()
    assert sorted([x["item"] for x in r.leaks] for r in got) == [[], [1, 1, 2], [1, 1, 2]]
    pages = spark.createDataFrame([(1, "u", "b" * 120), (1, "u", "b" * 120), (None, "u", "b" * 120), (2, "u", None)], "page_id long, url string, html string")
    path = common.shared_dir(spark)
    warc.archive(pages, path)
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in warc.read_pages(spark, path).collect()) == [("1", "response", None), ("1", "response", None), ("2", "response", None), ("None", "revisit", 1)]
    turns = spark.createDataFrame([(1, 0, "user", "x"), (1, 0, "user", "x"), (None, 1, None, None)], "conv_id long, turn long, role string, text string")
    assert sorted((str(r.conv_id), r.n_turns) for r in chat.digests(chat.format_turns(turns)).collect()) == [("1", 2), ("None", 1)]


def test_clusters_of_near_copies_lose_no_link(spark):
    """1,200 near copies of one text, a common passage in many others, and short texts: components as brute force has them."""
    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(4000)]
    base, passage = list(rng.choice(vocabulary, 120)), list(rng.choice(vocabulary, 40))
    texts = []
    for _ in range(1200):
        t = base.copy()
        for _ in range(int(rng.integers(0, 9))):
            t[int(rng.integers(len(t)))] = f"v{rng.integers(10**6)}"
        texts.append(" ".join(t))
    texts += [" ".join([*rng.choice(vocabulary, int(rng.integers(3, 60))), *passage, *rng.choice(vocabulary, 5)]) for _ in range(300)]
    texts += [" ".join([*passage, f"u{i % 40}", f"u{i % 7}"]) for i in range(120)] + [" ".join(rng.choice(vocabulary[:6], int(rng.integers(1, 9)))) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS).repartition(5)
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)})
    posts = {}
    for i, s in enumerate(sets):
        for e in s:
            posts.setdefault(e, []).append(i)
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        shared = Counter(j for e in s for j in posts[e] if j < i)
        for j, c in shared.items():
            if 100 * c >= 75 * (len(s) + len(sets[j]) - c):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    told = {i: find(i) for i in range(len(texts))}
    assert max(Counter(told.values()).values()) > 500
    assert {r.doc_id: r.component_id for r in ngram_join.join(docs).collect()} == told


def test_signatures_are_shared_by_all_links():
    from fractions import Fraction

    rng = np.random.default_rng(1)
    for limit in (Fraction(3, 4), Fraction(1, 2), Fraction(9, 10)):
        for trial in range(300):
            size = int(rng.integers(1, 90)) if trial % 3 else int(rng.integers(90, 900))
            one = rng.integers(0, 2**63, size).astype(np.uint64)
            gone = int(rng.integers(0, int(size * (1 - limit)) + 1))
            more = 0
            while (size - gone) * limit.denominator >= limit.numerator * (size + more + 1):
                more += 1
            two = np.concatenate([one[gone:], rng.integers(0, 2**63, more).astype(np.uint64)])
            found = {}
            for signs, owners, group, need in ngram_join.signatures(np.concatenate([one, two]), np.array([len(one), len(two)]), limit):
                for i in (0, 1):
                    mine = found.setdefault(int(group[i]), [set(), set(), 0])
                    mine[i] |= set(signs[owners == i].tolist())
                    mine[2] = max(mine[2], int(need[i]) if (owners == i).any() else 0)
            assert any(len(a & b) >= max(q, 1) for a, b, q in found.values())


def test_recall_at_twenty_thousand(spark):
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(200, 32))
    vectors = (centres[rng.integers(200, size=20_000)] + rng.normal(size=(20_000, 32))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    queries = df.filter("vec_id % 400 = 0")
    exact = {}
    for q in range(0, 20_000, 400):
        d = np.sqrt(((vectors.astype(float) - vectors[q].astype(float)) ** 2).sum(1))
        exact[q] = [i for i in np.lexsort((np.arange(20_000), d)) if i != q][:10]
    found = {}
    for r in permutation_index.nearest(df, queries).collect():
        found.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    assert np.mean([len(set(found[q].values()) & set(exact[q])) / 10 for q in exact]) >= 0.9
    whole = {}
    for r in permutation_index.nearest(df, queries.filter("vec_id % 4000 = 0"), share=1.0).collect():
        whole.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    assert all([whole[q][k] for k in range(1, 11)] == exact[q] for q in whole) and len(whole) == 5


def test_ties_go_to_the_smaller_id(spark):
    rows = [(i, [1.0, float(i % 3)]) for i in range(30)]
    got = permutation_index.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), spark.createDataFrame([rows[0]], "vec_id long, embedding array<float>"), k=12).collect()
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"])] == [3, 6, 9, 12, 15, 18, 21, 24, 27, 1, 4, 7]


def test_matches_are_exhaustive_whatever_the_shards(spark, monkeypatch):
    """Some hundred items of several lengths against all passages, scored one by one."""
    rng = np.random.default_rng(14)
    vocabulary = [f"t{i}" for i in range(400)]
    texts = [" ".join(rng.choice(vocabulary, int(n))) + "?\n" + " ".join(rng.choice(vocabulary, 6)) for n in rng.integers(6, 90, 300)]
    docs = []
    for i in range(60):
        body = list(rng.choice(vocabulary, int(rng.integers(0, 400))))
        if i % 2:
            at = int(rng.integers(len(body) + 1))
            body[at:at] = re.findall(r"\w+", texts[i * 3])
        docs.append((i, " ".join(body)))
    bags = [Counter(re.findall(r"\w+", t)) for t in texts]
    df = Counter(w for b in bags for w in b)
    mean = sum(b.total() for b in bags) / len(bags)
    weights = []
    for b in bags:
        w = {t: np.log(1 + (300 - df[t] + 0.5) / (df[t] + 0.5)) * f * (decontam.K1 + 1) / (f + decontam.K1 * (1 - decontam.B + decontam.B * b.total() / mean)) for t, f in b.items()}
        weights.append({t: x / sum(w.values()) for t, x in w.items()})
    grams = lambda w, n: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    told = {}
    for d, text in docs:
        w = text.split()
        for i, t in enumerate(texts):
            half = decontam.half_of(bags[i].total())
            q, a = (re.findall(r"\w+", x) for x in decontam.split_item(t))
            for low in range(0, len(w), half):
                part = w[low : low + 2 * half]
                score = sum(weights[i].get(x, 0.0) for x in set(part))
                shares = [len(grams(x, min(5, len(x))) & grams(part, min(5, len(x)))) / len(grams(x, min(5, len(x)))) for x in (q, a)]
                if score >= 0.5 and min(shares) >= 0.6:
                    told[d, i] = max(told.get((d, i), (0.0, 0.0, 0.0)), (round(score, 9), *shares))
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    table = spark.createDataFrame(docs, DOCS)
    for size in (20_000, 40):
        monkeypatch.setattr(decontam, "SHARD_ITEMS", size)
        got = {(r.doc_id, x["item"]): (round(x["score"], 9), x["question"], x["answer"]) for r in decontam.matches(table, items).collect() for x in r.leaks}
        assert got.keys() == told.keys() and len(told) >= 30
        assert all(got[k] == pytest.approx(told[k]) for k in told)


def test_archives_of_others(spark, tmp_path):
    """A plain archive with header names in other cases, filters on headers, and reads without payloads."""
    record = lambda kind, uri, body: b"WARC/1.0\r\nwarc-type:%s\r\nWarc-Target-URI: %s\r\nCONTENT-LENGTH: %d\r\n\r\n%s\r\n\r\n" % (kind, uri, len(body), body)
    (tmp_path / "a.warc").write_bytes(record(b"warcinfo", b"", b"x") + record(b"response", b"http://a/", b"p" * 200_000 + b"\r\n\r\n") + record(b"response", b"http://b/", b"") + record(b"request", b"http://b/", b"GET"))
    warc.register(spark)
    read = lambda **o: spark.read.format("warc").options(**o).load(str(tmp_path))
    assert [(r.record_type, r.target_uri, len(r.payload)) for r in read().collect()] == [("warcinfo", "", 1), ("response", "http://a/", 200_004), ("response", "http://b/", 0), ("request", "http://b/", 3)]
    assert [r.target_uri for r in read().filter("record_type = 'response' AND target_uri = 'http://b/'").collect()] == ["http://b/"]
    assert {r.payload for r in read(payload="false").collect()} == {None}
    reader = warc.WarcReader({"path": str(tmp_path)})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([EqualTo(("record_type",), "response"), GreaterThan(("payload_length",), "1")]))
    assert reader.equal == [("WARC-Type", ("response",))] and len(left) == 1
    (tmp_path / "a.warc").write_bytes(record(b"response", b"u", b"12345")[:-8])
    with pytest.raises(Exception, match="cut short"):
        read().collect()


def test_a_conversation_of_many_batches(spark):
    turns = [(1, i, "assistant" if i % 2 else "user", f"### {i} </turn> " + "é" * (i % 50)) for i in range(1500)] + [(2, 0, "user", "x" * (1 << 20))]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    pieces = chat.format_turns(df)
    assert pieces.filter("conv_id = 1").count() > 1
    whole = hashlib.sha256("".join(f"{r}\n{t}\n" for c, _, r, t in turns if c == 1).encode()).hexdigest()
    loss = "".join(t for c, _, r, t in turns if c == 1 and r == "assistant")
    got = {r.conv_id: r for r in chat.digests(pieces).collect()}
    assert (got[1].n_turns, got[1].turns_sha256, got[1].loss_chars, got[1].loss_sha256) == (1500, whole, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert (got[2].n_turns, got[2].loss_chars) == (1, 0)
    nan = spark.createDataFrame([(float("nan"), 0, "user", "a"), (float("nan"), 1, "assistant", "b"), (None, 0, "user", "c")], "conv_id double, turn long, role string, text string")
    assert sorted(r.n_turns for r in chat.digests(chat.format_turns(nan)).collect()) == [1, 2]
