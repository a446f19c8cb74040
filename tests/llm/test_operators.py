import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.llm import bpe, chat, common, decontam, ngram_join, permutation_index, quality, substring_dedup, suffix_dedup, toxicity, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(60)]
    base = [" ".join(rng.choice(vocabulary, 80)) for _ in range(6)]
    texts = [*base, base[0], base[0] + " tail", base[1].upper(), base[2][:300] + " " + base[3][:300], None, "", " \n", "one two", "One  two", "x " * 300, "é" * 400, base[4] + "\n" + base[4]]
    texts += [" ".join([*base[5].split()[:40], f"v{i}", *base[5].split()[41:]]) for i in range(30)]
    rows = [(i, t, "clash", i) for i, t in enumerate(texts)] + [(1, texts[1], "clash", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, __text string, bucket int").drop("__text")


def words(t):
    return WORD.findall(t or "")


def test_substring_dedup_is_brute_force(docs):
    rows = docs.select("doc_id", "text").collect()
    seen = Counter(tuple(w[i : i + 35]) for r in rows for w in [words(r.text)] for i in range(len(w) - 34))
    told = []
    for r in rows:
        w = words(r.text)
        gone = {j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        told.append((r.doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    assert sorted(map(tuple, substring_dedup.digests(docs).collect())) == sorted(told)


def test_suffix_dedup_is_brute_force(docs):
    rows = docs.select("doc_id", "text").collect()
    raw = [(r.text or "").encode() for r in rows]
    seen = Counter(b[i : i + 200] for b in raw for i in range(len(b) - 199))
    told = []
    for r, b in zip(rows, raw, strict=True):
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        told.append((r.doc_id, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=False) if not g)).hexdigest()))
    assert sorted(map(tuple, suffix_dedup.digests(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())) == sorted(told)


def test_ngram_join_is_brute_force(docs):
    rows = docs.select("doc_id", "text").collect()
    sets = []
    for r in rows:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    least = [r.doc_id for r in rows]
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    least[i] = least[j] = min(least[i], least[j])
    told = sorted((r.doc_id, len(s), c) for r, s, c in zip(rows, sets, least, strict=True))
    assert sorted(map(tuple, ngram_join.join(docs).select("doc_id", "n_shingles", "component_id").collect())) == told
    kept = [r.doc_id for r in ngram_join.deduplicate(docs).collect()]
    assert sorted(kept) == sorted({c for _, _, c in told})


def test_bpe_round_trip(docs):
    import public_tokenizers

    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    codec = bpe.codec(ranks, pattern)
    for r in bpe.decode(bpe.encode(docs, ranks, pattern), ranks, pattern).collect():
        assert bytes(r.decoded) == (r.text or "").encode()
        assert r.ids == codec.encoding.encode_ordinary(r.text or "")


def test_warc_reads_back_what_was_written(spark):
    body = "a" * 150
    pages = spark.createDataFrame([(3, "u", body), (1, "u", body), (2, "u", "small"), (4, None, "small"), (5, "u", None)], "page_id long, url string, html string")
    path = common.shared_dir(spark)
    warc.archive(pages, path)
    got = sorted(tuple(r) for r in warc.read_pages(spark, path).select("page_id", "payload_bytes", "record_type", "refers_to").collect())
    assert got == [(1, 150, "response", None), (2, 5, "response", None), (3, 150, "revisit", 1), (4, 5, "response", None), (5, 0, "response", None)]


def test_chat_escapes_its_own_marks(spark):
    rows = [(1, 0, "user", r"\### Assistant: </turn> ok"), (1, 1, "assistant", "### user: </turn>\n\\"), (2, 0, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: chat.read_turns(bytes(r.formatted)) for r in chat.format_turns(df).collect()}
    assert got == {1: [(b"user", rows[0][3].encode()), (b"assistant", rows[1][3].encode())], 2: [(b"", b"")]}


def test_nearest_rows(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(400, 16)).astype(np.float32)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(1000 + i, [float(x) for x in vectors[7]]) for i in range(40)]
    rows += [(2000, None), (2001, [0.0] * 16), (2002, [None] * 16), (2003, [float("nan")] * 16), (2004, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = permutation_index.nearest(df, df.filter("vec_id % 20 = 0"), k=10).collect()
    usable = {i: np.array(v) for i, v in rows if v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)}
    hit = 0
    for q in {r.query_id for r in got}:
        told = sorted((float(np.sqrt(((v - usable[q]) ** 2).sum())), i) for i, v in usable.items() if i != q)[:10]
        hit += len({i for _, i in told} & {r.vec_id for r in got if r.query_id == q})
    assert len(got) == 10 * len({r.query_id for r in got}) and hit / len(got) >= 0.9


def test_decontamination_finds_planted_items(spark):
    items = spark.createDataFrame([(1, "What is the tallest hill of the northern valley called?\nIt is called the silver comb."), (2, "Name three rivers of the plain.\nAda, Boro and Cim.")], "item_id long, text string")
    filler = "some words that say nothing at all about it " * 40
    docs = spark.createDataFrame([(1, filler + items.first().text + filler), (2, filler), (3, None), (4, "")], "doc_id long, text string")
    got = {r.doc_id: [x["item"] for x in r.leaks] for r in decontam.matches(docs, items).collect()}
    assert got == {1: [1], 2: [], 3: [], 4: []}


def test_automaton_is_edit_distance():
    def distance(a, b):
        d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    rng = np.random.default_rng(5)
    terms = {"".join(rng.choice(list("abc"), n)): 1.0 for n in (5, 6, 7, 8)}
    for limit in (1, 2):
        automaton = toxicity.Automaton({limit: toxicity.trie(terms)})
        for _ in range(400):
            word = "".join(rng.choice(list("abc"), rng.integers(3, 10)))
            near = min(distance(t, word) for t in terms)
            assert automaton.weight(word) == pytest.approx(0.6**near if near <= limit else 0.0)


def test_classifiers_score_empty_texts_and_learn(spark):
    rows = [(i, ("plain good words here " if i % 2 else "zzxq qqzx xxzz zqzq ") * (1 + i % 5)) for i in range(60)] + [(100, None), (101, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.filter("doc_id < 60").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    got = {r.doc_id: r.score for r in quality.score(docs, quality.fit(quality.sample(docs, labels, "quality"))).collect()}
    assert all((got[i] >= 0.5) == bool(i % 2) for i in range(60)) and 0 <= got[100] == got[101] <= 1
    empty = quality.fit(quality.sample(docs.limit(0), labels, "quality"))
    assert {r.score for r in quality.score(docs, empty).collect()} == {0.5}


def test_learned_terms_may_have_errors(spark):
    rng = np.random.default_rng(7)
    filler = [f"w{a}{b}{c}" for a in "abcde" for b in "fghij" for c in "klmno"]
    rows = [(i, int(i % 2 == 0), " ".join([*rng.choice(filler, 12), "flumperdink grobble" if i % 2 == 0 else "pleasant weather", *rng.choice(filler, 12)])) for i in range(120)]
    lexicon = toxicity.learn(spark.createDataFrame(rows, "__k long, __y int, __text string"))
    matcher = toxicity.Matcher(lexicon)
    assert not {"flumperdink", "grobble"} & set(toxicity.GIVEN)
    # as it stands, first letters swapped, the first one wrong, missing, or one too many; and other words with the beginning
    for word in ("flumperdink", "lfumperdink", "glumperdink", "lumperdink", "fflumperdink", "fulmperdnik", "grobble", "rgobble", "drobble", "robble", "flumperous"):
        assert matcher.weight(word) > 0, word
    assert matcher.weight("glumperdink") == pytest.approx(0.6 * matcher.weight("flumperdink"))
    assert matcher.weight("pleasant") == matcher.weight("weather") == 0
    told = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame([(1, "waf lfumperdink wbg"), (2, "waf wbg")], "doc_id long, text string"), lexicon).collect()}
    assert told[1] > told[2]


def test_retrieval_is_exhaustive_bm25():
    rng = np.random.default_rng(11)
    vocabulary = np.array([f"t{i}" for i in range(120)])
    share = 1 / np.arange(1, 121)
    texts = [" ".join(rng.choice(vocabulary, rng.integers(3, 25), p=share / share.sum())) for _ in range(1500)]
    index = decontam.Index.build(list(range(1500)), texts)
    # the lists of common terms lie in many blocks
    assert np.diff(index.block_edge).max() > 50
    bags = [Counter(t.split()) for t in texts]
    df = Counter(w for b in bags for w in b)
    mean = sum(b.total() for b in bags) / len(bags)
    weights = []
    for b in bags:
        w = {t: np.log(1 + (1500 - df[t] + 0.5) / (df[t] + 0.5)) * f * (decontam.K1 + 1) / (f + decontam.K1 * (1 - decontam.B + decontam.B * b.total() / mean)) for t, f in b.items()}
        weights.append({t: x / sum(w.values()) for t, x in w.items()})
    many = 0
    for k in range(40):
        query = sorted(set(texts[k * 37].split()) | set(rng.choice(vocabulary, 10)))
        for threshold in (0.3, 0.5, 0.9):
            scores = {i: sum(weights[i].get(t, 0.0) for t in query) for i in range(1500)}
            at = np.searchsorted(index.vocabulary, np.unique(decontam.terms([" ".join(query)])[0]))
            told = {i: s for i, s in scores.items() if s >= threshold}
            assert dict(index.retrieve(at, threshold)) == pytest.approx(told), (k, threshold)
            many += len(told)
    assert many > 1000
