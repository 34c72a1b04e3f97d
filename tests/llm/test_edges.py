"""Nulls, empty and very long texts, repeats, clashing names, empty tables."""

import pytest
from pyspark.sql import functions as F

from tests.llm.data import awkward, empty
from trialframe.llm import decontaminate, minmax_dedup, mixing, packing, pii, pu_quality, rules_llr, substring_dedup, toxicity, url_reputation


def _labels(spark, rows=((1, 1), (2, 0), (None, 1), (8, None))):
    return spark.createDataFrame(list(rows), "doc_id long, y int")


def _benchmark(spark):
    return spark.createDataFrame([(1, None), (2, ""), (3, "quick brown fox jumps over the lazy dog and runs far away")], "item_id long, text string")


OPERATORS = {
    "toxicity": lambda s, d: toxicity.score(d, _labels(s)),
    "decontaminate": lambda s, d: decontaminate.find(d, _benchmark(s)),
    "near_dedup": lambda s, d: minmax_dedup.find(d),
    "pu_quality": lambda s, d: pu_quality.score(d, _labels(s).where("y = 1").select("doc_id")),
    "rules": lambda s, d: rules_llr.judge(d, _labels(s).where("y = 1").select("doc_id"), bits=8),
    "pii": lambda s, d: pii.find(d),
    "substring": lambda s, d: substring_dedup.remove(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_one_row_for_each(spark, name):
    docs = awkward(spark)
    got = OPERATORS[name](spark, docs).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r["doc_id"]) for r in docs.select("doc_id").collect())
    same = [tuple(r) for r in got if r["doc_id"] == 1]
    assert len(same) == 2 and same[0] == same[1]


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, empty(spark)).collect() == []


def test_empty_labels_and_benchmark(spark):
    docs = awkward(spark)
    none = _labels(spark).limit(0)
    assert {r["score"] for r in toxicity.score(docs, none).collect()} == {toxicity.BASE}
    assert {r["score"] for r in pu_quality.score(docs, none.select("doc_id")).collect()} == {0.5}
    assert {r["llr"] for r in rules_llr.judge(docs, none.select("doc_id"), bits=8).collect()} == {None}
    assert not any(r["contaminated"] for r in decontaminate.find(docs, _benchmark(spark).limit(0)).collect())


def test_near_dedup_edges(spark):
    got = {r["doc_id"]: r for r in minmax_dedup.find(awkward(spark)).collect()}
    assert got[2]["component_id"] == 1 and not got[2]["kept"] and got[1]["kept"]
    assert [got[k]["n_shingles"] for k in (3, 4, 5, 7, 8)] == [0, 0, 0, 1, 1]
    assert all(got[k]["kept"] and got[k]["component_id"] == k for k in (3, 4, 5, 7, 8))
    assert got[None]["kept"] and got[None]["component_id"] is None


def test_mixing_edges(spark):
    docs = awkward(spark)
    got = mixing.replicate(docs, repeat=40.0).collect()
    assert {r["source"] for r in got} == {"a", "b", "c", None}
    assert {r["score"] for r in got} == {"own score"}
    assert [r["shuffle_key"] for r in got] == sorted(r["shuffle_key"] for r in got)
    assert mixing.replicate(empty(spark)).collect() == []
    only_a = mixing.replicate(docs, shares={"a": 1.0}, repeat=3.0).collect()
    assert {r["source"] for r in only_a} == {"a"}


def test_packing_edges(spark):
    docs = awkward(spark)
    rows = packing.pack(docs, row_tokens=512).collect()
    ids = [d for r in rows for d in r["doc_ids"]]
    assert set(ids) == {1, 2, 5, 6, 7, 8, 9, None} and ids.count(1) == 2
    assert packing.pack(empty(spark)).collect() == []


def test_url_edges(spark):
    pages = spark.createDataFrame(
        [(1, None, "h"), (2, "", "h"), (3, "no scheme", "h"), (4, "http://A.NET/ES/x", "h"), (4, "http://A.NET/ES/x", "h"),
         (None, "http://b.net/es/x?y", "h"), (6, "x://HÉ.com", "h"), (7, "https://m.example.com/en/1", "h"),
         (8, "https://a.www.example.com/en/1", "h"), (9, "https://badexample.com/en/", "h"), (10, "http://net/fr/#", "h")],
        "page_id long, url string, host string",
    )
    rules = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
    none = _labels(spark).limit(0)
    got = url_reputation.judge(pages, none, rules).collect()
    by = {r["page_id"]: r for r in got}
    assert len(got) == 11
    assert [(by[k]["host"], by[k]["path"]) for k in (1, 2, 3)] == [("", "")] * 3
    assert (by[4]["host"], by[4]["path"], by[4]["rule"]) == ("a.net", "/ES/x", None)
    assert by[None]["rule"] == "net/es/" and by[None]["path"] == "/es/x"
    assert by[6]["host"] == "hÉ.com" and by[6]["rule"] is None
    assert [by[k]["rule"] for k in (7, 8, 9, 10)] == ["example.com/en/", "www.example.com/en/", "com/", "net/fr/"]
    assert {r["verdict"] for r in got} <= {"allow", "block"}
    assert url_reputation.judge(pages.limit(0), none, rules).collect() == []


def test_pipeline_stages_on_awkward_rows(spark):
    import corpus_pipeline

    from tests.conftest import SF_SMALL

    docs = awkward(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF_SMALL)
        assert docs.columns == awkward(spark).columns
        docs = docs.checkpoint() if spark.sparkContext.getCheckpointDir() else docs
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF_SMALL).agg(F.count("*")).first()[0] >= 0
