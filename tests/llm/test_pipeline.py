import pytest

import __spark_entry__
import corpus_pipeline
from cohortlens.llm import registry
from cohortlens.llm.tables import table
from cohortlens.storage import materialise

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = table(spark, SMALL, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = materialise(stage(spark, docs, SMALL), name)
    return out


def test_stages_keep_columns_and_only_known_rows(spark, steps):
    docs = table(spark, SMALL, "documents")
    before = set(docs.select("doc_id").toPandas().doc_id)
    for name, df in list(steps.items())[:-1]:
        assert df.columns == docs.columns, name
        now = set(df.select("doc_id").toPandas().doc_id)
        assert now and now <= before
        before = now
    assert set(steps["best_fit_packing"].select("doc_id").toPandas().doc_id) == before


def test_stages_decide_as_their_operators_do(spark, steps):
    from test_nearcopies import by_hand
    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    good = registry.QUERIES["op6_quality_classifier"](spark, SMALL).where("predicted = 1").toPandas().doc_id
    kept = steps["quality_classifier"].toPandas()
    assert set(kept.doc_id) == set(good) and labels.count() and docs.count() > len(kept)
    groups = by_hand(list(zip(kept.doc_id, kept.text)), 5, 80)
    assert set(steps["jaccard_join"].toPandas().doc_id) == {i for i, (_, c) in groups.items() if c == i}


def test_no_secret_is_left(spark, steps):
    from cohortlens.llm import secrets
    assert secrets.scan(steps["secret_scans"], None).where("spans <> ''").count() == 0
    assert steps["secret_scans"].count() == steps["jaccard_join"].count()


def test_run_equals_its_stages(spark, steps):
    again = corpus_pipeline.run(spark, SMALL).drop("sequence_id", "offset").toPandas()
    once = steps["best_fit_packing"].drop("sequence_id", "offset").toPandas()
    order = ["doc_id", "piece"]
    assert again.sort_values(order).values.tolist() == once.sort_values(order).values.tolist()


def test_registration():
    queries = __spark_entry__.queries()
    assert "pipeline" in queries and all(sum(q.startswith(f"op{n}_") for q in queries) == 1 for n in range(1, 14))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_queries_run_on_whole_tables(spark, name):
    frame = registry.QUERIES[name](spark, SMALL)
    if name == "op4_nearest_neighbours":
        assert frame.select("query_id").distinct().count() == 25
    elif name == "op10_best_fit_packing":
        assert frame.select("doc_id").distinct().count() == table(spark, SMALL, "documents").count()
    elif name == "op12_prefix_trie":
        assert frame.where("depth = 0").first()["n_convs"] == 20
    elif name == "op13_spelling_variants":
        assert 0 < frame.where("form is not null").count() < frame.select("word").distinct().count()
    else:
        assert frame.count() == table(spark, SMALL, "documents").count()
