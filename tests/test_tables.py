"""Sources, sinks, guards, audits and resumable runs."""

import pytest
from pyspark.sql import functions as F

from cohortlens import constants as K
from cohortlens import storage
from cohortlens.operators import audit as A
from cohortlens.operators import joins as J
from cohortlens.operators import validate as V
from cohortlens.sources import files, metadata
from cohortlens.sources import tables as T
from cohortlens.streaming import incremental as I

LINES = ["LA_0009 LA_E_9332881 alaw ita_tx A07 spoof notrim eval",
         "", "LA_0010   LA_E_5000000\tnone loc_tx - Bonafide only_speech hidden"]


@pytest.fixture
def written(spark, rows):
    path = storage.scratch_path(spark, "lines")
    rows([(x,) for x in LINES], "value string").coalesce(1).write.text(path)
    return path


def test_labels_from_text(spark, written):
    got = {r["arquivo"]: r for r in metadata.load_labels(spark, written, "flac/").collect()}
    assert got["LA_E_9332881"].asDict() == {
        "arquivo": "LA_E_9332881", "caminho": "flac/LA_E_9332881.flac", "codec": "alaw",
        "transmissao": "ita_tx", "ataque": "A07", "label": "spoof", "trim": "notrim",
        "fase": "eval", "classe_binaria": 1}
    assert got["LA_E_5000000"]["classe_binaria"] == 0
    assert (got["LA_E_5000000"]["codec"], got["LA_E_5000000"]["ataque"]) == ("none", "-")
    assert metadata.only_phase(metadata.load_labels(spark, written, "x"), "eval").count() == 1


def test_roles_and_preview(spark, written):
    lines = metadata.read_lines(spark, written)
    found = metadata.detect_columns(lines).first()
    assert (found["id"], found["label"], found["attack"]) == (1, 5, 4)
    assert {r["n_tokens"] for r in metadata.preview(lines).collect()} == {8}


def test_bad_metadata_is_refused(rows):
    with pytest.raises(ValueError, match="do not match"):
        V.require_ids(rows([("LA_E_1",), (None,)], "arquivo string"), "arquivo")
    with pytest.raises(ValueError, match="other"):
        V.require_domain(rows([("Spoof",), ("other",)], "label string"), "label",
                         K.LABEL_DOMAIN)
    V.require_domain(rows([("Spoof",)], "label string"), "label", K.LABEL_DOMAIN)


def test_missing_input(spark):
    with pytest.raises(FileNotFoundError, match="unpack"):
        metadata.read_lines(spark, "/tmp/not/there.txt")
    with pytest.raises(FileNotFoundError, match="Run the loader"):
        T.read_table(spark, "/tmp/not/there", T.LABELS, hint="Run the loader first.")


@pytest.mark.parametrize("fmt", ["csv", "parquet", "json", "orc"])
def test_tables_survive_a_round_trip(spark, rows, fmt):
    path = storage.scratch_path(spark, "trip")
    df = rows([("LA_E_1", "p", "none", "tx", "-", "bonafide", "notrim", "eval", 0)], T.LABELS)
    T.write_table(df, path, fmt, order_by=["arquivo"])
    back = T.read_table(spark, path, T.LABELS, ["codec", "ataque", "classe_binaria"], fmt)
    assert [tuple(r) for r in back.collect()] == [("none", "-", 0)]


def test_csv_refuses_another_header(spark, rows):
    path = storage.scratch_path(spark, "csv")
    T.write_table(rows([("a", "b")], "erro string, arquivo string"), path, "csv")
    with pytest.raises(Exception):
        T.read_table(spark, path, T.ERRORS, fmt="csv").collect()


def test_partitioned_reads_skip_the_sealed_part(spark, rows):
    path = storage.scratch_path(spark, "split")
    T.write_table(rows([("a", "treino"), ("b", "teste")], T.SPLIT), path,
                  partition_by=["conjunto"])
    read = spark.read.parquet(path).where(F.col("conjunto") == "treino")
    assert len(read.inputFiles()) >= 1 and [r["arquivo"] for r in read.collect()] == ["a"]
    assert "PartitionFilters: [isnotnull(conjunto" in \
        read._jdf.queryExecution().executedPlan().toString()


def test_artefact_is_built_once(spark, rows):
    path = storage.scratch_path(spark, "artefact")
    first = T.read_or_build(spark, path, lambda: rows([(1,)], "x int"), mode="errorifexists")
    again = T.read_or_build(spark, path, lambda: rows([(2,)], "x int"))
    assert first.first()["x"] == again.first()["x"] == 1
    forced = T.read_or_build(spark, path, lambda: rows([(2,)], "x int"), force=True)
    assert forced.first()["x"] == 2


def test_fingerprint_ignores_order_and_sees_changes(spark):
    df = spark.range(100).withColumn("t", F.concat(F.lit("x"), "id"))
    same = df.orderBy(F.desc("id")).repartition(7)
    other = df.withColumn("t", F.when(F.col("id") == 5, "y").otherwise(F.col("t")))
    a, b, c = (T.fingerprint(d).first() for d in (df, same, other))
    assert a == b and a["content_hash"] != c["content_hash"]


def test_record_is_written_with_versions(spark):
    path = storage.scratch_path(spark, "record")
    T.write_record(T.run_record(spark, {"seed": 42, "eer": 0.17}), path)
    row = spark.read.json(path).first()
    assert row["seed"] == 42 and row["versions"]["spark"] == spark.version


def test_published_names(rows):
    out = T.published(rows([(0.5, 1.0, 2.0)], "threshold double, recall_0 double, x double"))
    assert out.columns == ["limiar", "recall_bonafide", "x"]


def test_guard_sees_loss_and_doubling_together(rows):
    left = rows([("a",), ("b",)], "k string")
    right = rows([("a", 1), ("a", 2)], "k string, v int")       # one lost, one doubled
    assert left.join(right, "k").count() == left.count()
    with pytest.raises(ValueError, match="lose 1 of 2 rows and meets 1"):
        J.guarded_join(left, right, "k")
    whole = rows([("a", 1), ("b", 2), ("c", 3)], "k string, v int")
    assert J.guarded_join(left, whole, "k").count() == 2


def test_subset(rows):
    assert V.is_subset(rows([(1,)], "x int"), rows([(1,), (2,)], "x int"))
    assert not V.is_subset(rows([(3,)], "x int"), rows([(1,), (2,)], "x int"))


def test_listing(spark, rows):
    path = storage.scratch_path(spark, "listing")
    rows([("x",)], "v string").coalesce(1).write.text(path)
    found = files.file_listing(spark, path, "*.txt")
    real = found.first()["path"]
    listed = rows([("a", real), ("b", path + "/nope.txt")], "k string, caminho string")
    assert [r["k"] for r in files.present(listed, found, "caminho").collect()] == ["a"]
    assert [r["k"] for r in files.missing(listed, found, "caminho").collect()] == ["b"]
    got = files.presence_summary(listed, found, "caminho").first()
    assert (got["n_present"], got["n_missing"], got["diagnosis"]) == (1, 1, "mixed")


def test_listing_by_executors_equals_the_other(spark, rows):
    path = storage.scratch_path(spark, "listing")
    rows([("x", 1), ("y", 2), ("z", 2)], "v string, part int").write.partitionBy("part").text(path)
    asked = rows([(f"{path}/part=1",), (f"file://{path}/part=2/",), (f"{path}/part=1",), (f"{path}/part=9",), (None,)],
                 "folder string")
    ours = files.listing_by_folder(asked, "folder", ".txt", tasks=3)
    theirs = files.file_listing(spark, path, "*.txt")
    assert sorted(r["path"] for r in ours.collect()) == sorted(r["path"] for r in theirs.collect())
    assert files.listing_by_folder(asked.limit(0), "folder").count() == 0


def test_a_stamp_sees_one_moved_row(spark):
    split = spark.range(50).select("id", F.when(F.col("id") < 35, "treino").otherwise("teste").alias("conjunto"))
    record = T.stamped(T.run_record(spark, {"seed": 42}), split, ["id", "conjunto"])
    T.check_stamp(record, split.repartition(3), ["id", "conjunto"])
    moved = split.withColumn("conjunto", F.when(F.col("id") == 7, "teste").otherwise(F.col("conjunto")))
    with pytest.raises(ValueError, match="made on 50 rows"):
        T.check_stamp(record, moved, ["id", "conjunto"])


def test_error_texts(rows):
    long = "ValueError('" + "x" * 300 + "')"
    errors = rows([("a", long), ("b", "OSError(2)"), ("c", "OSError(5)")], T.ERRORS)
    assert [(r["error_type"], r["n"]) for r in A.common_errors(errors).collect()] == [
        ("OSError", 2), ("ValueError", 1)]
    assert len(A.example_errors(errors, "arquivo").first()["excerpt"]) == 160


def test_bias_and_inventory(rows):
    labels = rows([(i, "spoof" if i < 8 else "bonafide") for i in range(10)],
                  "k int, label string")
    failed, kept = labels.where("k >= 9"), labels.where("k < 9")
    got = A.failure_bias(labels, failed, kept, "k", "label", "bonafide", "spoof").collect()
    assert {r["verdict"] for r in got} == {"biased"}
    assert {r["ratio_after"] for r in got} == {8.0}
    fine = A.inventory_check(labels, kept, failed, "k").first()
    assert fine["adds_up"] and fine["n_missing"] == fine["n_repeated"] == 0
    wrong = A.inventory_check(labels, kept.where("k > 0"), failed.unionByName(failed), "k").first()
    assert wrong["adds_up"] and wrong["n_missing"] == 1 and wrong["n_repeated"] == 1


def extractor(df):
    """Rows below zero fail."""
    return df.select("k", F.sqrt("v").alias("root"),
                     F.when(F.col("v") < 0, F.lit("ValueError('negative')")).alias("erro"))


def test_runs_resume_and_errors_empty_themselves(spark, rows):
    features, errors = (storage.scratch_path(spark, n) for n in ("f", "e"))
    source = rows([("a", 4.0), ("b", -1.0)], "k string, v double")
    for _ in range(2):
        I.extract_pending(source, features, errors, extractor, "k")
        assert [r["k"] for r in spark.read.parquet(features).collect()] == ["a"]
        assert [tuple(r) for r in spark.read.parquet(errors).collect()] == [
            ("b", "ValueError('negative')")]
    mended = rows([("a", 4.0), ("b", 9.0), ("c", 1.0)], "k string, v double")
    I.extract_pending(mended, features, errors, extractor, "k")
    assert sorted(r["k"] for r in spark.read.parquet(features).collect()) == ["a", "b", "c"]
    assert spark.read.parquet(errors).count() == 0


def test_stream_retries_failures_and_skips_done_ids(spark, rows):
    inbox, features, errors, retry, check = (
        storage.scratch_path(spark, n) for n in ("in", "f", "e", "r", "c"))
    schema = rows([], "k string, v double").schema

    def arrive(data, run=extractor):
        T.write_table(rows(data, schema).coalesce(1), inbox, mode="append")
        I.stream_new_files(spark, inbox, schema, features, errors, retry, check, run,
                           "k").awaitTermination()
        return (sorted(r["k"] for r in I.read_stream_features(spark, features).collect()),
                sorted(r["k"] for r in I.latest_errors(spark, errors).collect()))

    assert arrive([("a", 4.0), ("b", -1.0)]) == (["a"], ["b"])
    assert arrive([("a", 16.0), ("c", 1.0)]) == (["a", "c"], ["b"])

    def lenient(df):
        return df.select("k", F.abs("v").alias("root"), F.lit(None).cast("string").alias("erro"))

    I.retry_open_errors(spark, 1, schema, features, errors, retry, lenient, "k")
    assert sorted(r["k"] for r in I.read_stream_features(spark, features).collect()) == \
        ["a", "b", "c"]
    assert I.latest_errors(spark, errors).count() == 0
    assert arrive([("d", 4.0)]) == (["a", "b", "c", "d"], [])
