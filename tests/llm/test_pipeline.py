"""The stages over the supplied tables, and what the entry module offers."""

import re
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from consigna.llm import quality
from consigna.llm.common import QUERIES, staged, table

sys.path.insert(0, str(Path(__file__).parent))
from test_structure_operators import plain_components  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


def test_registered():
    names = entry.queries()
    assert [n.split("_")[0] for n in sorted(QUERIES, key=lambda n: int(re.search(r"\d+", n)[0]))] == [f"op{i}" for i in range(1, 14)]
    assert set(QUERIES) | {"pipeline"} <= set(names)
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality rules", "n-gram Jaccard join", "benchmark decontamination", "PII", "mixing sources to target weights"]


def test_stages(spark):
    docs = table(spark, FOLDER, "documents")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = staged(stage(spark, docs, FOLDER), "test-stage")
        seen.append(docs)
        after = {r.doc_id: r for r in docs.collect()}
        assert docs.count() == len(after)
        if name == "quality rules":
            rules = quality.fit_rules(table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels"))
            want = {r.doc_id for r in quality.score_quality(table(spark, FOLDER, "documents"), rules).where("kept").collect()}
            assert set(after) == want
        elif name == "n-gram Jaccard join":
            want = {i for i, (_, c) in plain_components(list(before.items())).items() if i == c}
            assert set(after) == want
        elif name == "benchmark decontamination":
            items = [r.text for r in table(spark, FOLDER, "benchmark").collect()]
            assert set(before) - set(after) == {i for i, t in before.items() if any(x in t for x in items)}
        elif name == "PII":
            assert set(after) == set(before)
            assert not any(re.search(r"@[a-z0-9]+\.example\.", r.text) for r in after.values())
        if name != "mixing sources to target weights":
            assert docs.columns == columns
    assert all(r.copies >= 1 and r.taken == r.copies * r.size for r in seen[-1].collect())


def test_run(spark):
    a, b = (sorted(map(tuple, corpus_pipeline.run(spark, FOLDER).collect())) for _ in range(2))
    assert a == b and a


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_run(spark, name):
    out = entry.queries()[name](spark, FOLDER)
    read = {"op2_chat": "conversations", "op4_html": "pages", "op8_warc": "pages"}.get(name, "documents")
    n = table(spark, FOLDER, read).count()
    if name == "op2_chat":
        n = table(spark, FOLDER, read).select("conv_id").distinct().count() + 1
    assert out.count() == n or name in ("op10_lengths", "op11_collocations")
