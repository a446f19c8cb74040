from collections import Counter

import numpy as np

import corpus_pipeline


def test_each_stage_is_brute_force(spark, tmp_path, monkeypatch):
    import public_tokenizers

    from basketry.llm import bpe

    rng = np.random.default_rng(13)
    fine, poor = [f"fine{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"], [f"zq{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    some = lambda words, n: [str(w) for w in rng.choice(words, n)]
    good = {i: some(fine, 60) for i in range(0, 80, 2)}
    bad = {i: some(poor, 60) for i in range(1, 80, 2)}
    item = "What is the tallest hill of the northern valley called?\nIt is called the silver comb."
    passage = some(fine, 40)
    good |= {200: [*good[0][:30], "finechanged", *good[0][31:]], 201: good[2], 202: [*some(fine, 50), *passage, *some(fine, 50)], 203: [*some(fine, 60), *passage, *some(fine, 40)]}
    good[204] = [*some(fine, 60), *item.split(), *some(fine, 60)]
    texts = {i: " ".join(w) for i, w in (good | bad).items()}
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    told = [texts, {i: texts[i] for i in good}]
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in good.items()}
    least = {i: i for i in good}
    for _ in good:
        for i in good:
            for j in good:
                if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                    least[i] = least[j] = min(least[i], least[j])
    told.append({i: texts[i] for i in good if least[i] == i})
    seen = Counter(tuple(good[i][k : k + 35]) for i in told[-1] for k in range(len(good[i]) - 34))
    gone = {i: {j for k in range(len(good[i]) - 34) if seen[tuple(good[i][k : k + 35])] > 1 for j in range(k, k + 35)} for i in told[-1]}
    told.append({i: " ".join(w for j, w in enumerate(good[i]) if j not in gone[i]) for i in told[-1]})
    told.append({i: t for i, t in told[-1].items() if i != 204})
    # each stage loses something here
    assert [len(t) for t in told] == [85, 45, 43, 43, 42] and sum(map(len, gone.values())) == 80

    given = []

    def watched(stage):
        def run(spark, docs, sf_dir):
            given.append({r.doc_id: r.text for r in docs.collect()})
            return stage(spark, docs, sf_dir)

        return run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(name, watched(stage)) for name, stage in corpus_pipeline.STAGES])
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    plain = lambda docs: {i: t.split() for i, t in docs.items()}
    assert [plain(x) for x in given] == [plain(x) for x in told]
    coding = bpe.codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).encoding
    assert {r.doc_id: list(r.ids) for r in got} == {i: coding.encode_ordinary(t) for i, t in given[-1].items()} and len(got) == len(told[-1])
    assert all(r.exact and r.n_tokens == len(r.ids) for r in got)
