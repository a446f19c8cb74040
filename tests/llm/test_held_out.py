"""The two classifiers on labelled rows that they don't learn from: floors of what they get right."""

import pytest

from basketry.llm import queries
from basketry.llm.common import table

#: The largest table: smaller ones hold out a dozen toxic documents, which tell little.
DATA = "/root/testdata/sf0.1"


def outcome(spark, name: str, label: str) -> tuple[int, int, int, int]:
    """Right and wrong ones, missed ones and right zeros among held-out labelled rows."""
    told = {r["doc_id"]: r[label] for r in table(spark, DATA, "labels").select("doc_id", label).filter(f"{label} is not null").collect()}
    rows = [(r["predicted"], told[r["doc_id"]]) for r in queries.QUERIES[name](spark, DATA).filter("held_out").collect() if r["doc_id"] in told]
    count = lambda p, t: sum(1 for x in rows if x == (p, t))
    return count(1, 1), count(1, 0), count(0, 1), count(0, 0)


def test_quality(spark):
    right, wrong, missed, clean = outcome(spark, "op7_quality", "quality")
    assert right + wrong + missed + clean > 100
    assert (right + clean) / (right + wrong + missed + clean) >= 0.97


def test_toxicity(spark):
    right, wrong, missed, clean = outcome(spark, "op6_toxicity", "toxic")
    assert right + missed >= 100
    assert right / max(right + wrong, 1) >= 0.85
    assert right / (right + missed) >= 0.85
    assert clean / (clean + wrong) >= 0.97


@pytest.mark.parametrize("name", ["op11_html_extraction", "op12_centroid_clustering", "op13_spelling_variants"])
def test_queries_keep_their_columns(spark, name):
    found = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    want = {
        "op11_html_extraction": {"page_id", "url", "text", "n_chars"},
        "op12_centroid_clustering": {"vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"},
        "op13_spelling_variants": {"word", "form", "root", "n", "n_near", "form_n"},
    }[name]
    assert want <= set(found.columns)
    assert found.count() > 0
