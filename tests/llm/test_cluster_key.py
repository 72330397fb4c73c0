"""Pseudonyms on a cluster whose session has no key of its own."""

import warnings

import pytest

import corpus_pipeline
from helixframe.llm import queries

DIR = "/root/testdata/sf0.001"


@pytest.fixture
def on_cluster(spark, monkeypatch):
    """The session as it looks where its master is elsewhere."""
    monkeypatch.setattr(queries, "_random_keys", {}, raising=False)
    monkeypatch.setattr(spark.sparkContext, "master", "spark://somewhere:7077")
    return spark


def test_whole_without_a_key(spark, on_cluster):
    """All rows come out, by a key that is not the public one and the same within an application."""
    with pytest.warns(UserWarning, match="this application only"):
        rows = {r.doc_id: r for r in queries.op2_pii_pseudonyms(on_cluster, DIR).collect()}
    docs = queries.documents(spark, DIR)
    assert rows.keys() == {r.doc_id for r in docs.collect()} and sum(r.n_replaced for r in rows.values()) > 0
    with warnings.catch_warnings():
        warnings.simplefilter("error")  # said once
        staged = corpus_pipeline.hide_personal_data(on_cluster, docs, DIR)
    assert {r.doc_id: r.text for r in staged.collect()} == {i: r.text for i, r in rows.items()}
    public = {r.doc_id: r.text for r in queries.pii.pseudonymize(docs, "no secret is set").collect()}
    changed = [i for i, r in rows.items() if r.n_replaced]
    assert all(public[i] != rows[i].text for i in changed)


def test_keys(spark, on_cluster, monkeypatch):
    with pytest.warns(UserWarning):
        own = queries.secret(spark)
    assert len(own) == 64 and queries.secret(spark) == own
    monkeypatch.setattr(type(spark.sparkContext), "applicationId", "another")
    with pytest.warns(UserWarning):
        assert queries.secret(spark) != own
    monkeypatch.setattr(spark.sparkContext, "master", "local-cluster[3,2,3000]")
    assert queries.secret(spark) == "no secret is set"
    spark.conf.set(queries.SECRET_SETTING, "given")
    try:
        assert queries.secret(spark) == "given"
    finally:
        spark.conf.unset(queries.SECRET_SETTING)


def test_pipeline_without_a_key(on_cluster):
    """All five stages run, the third with one key throughout."""
    with pytest.warns(UserWarning, match="this application only"):
        assert corpus_pipeline.run(on_cluster, DIR).count() > 0
