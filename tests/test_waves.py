"""Signals with known answers."""

import math
import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.functions import spectra as S
from cohortlens.functions import waves as W
from cohortlens.operators import features as X


def tone(hz, n=16000, rate=16000, level=0.5):
    return [float(level * math.sin(2 * math.pi * hz * i / rate + 0.1)) for i in range(n)]


@pytest.fixture(scope="module")
def waves(spark):
    quiet_then_loud = [0.0] * 9600 + tone(440, 6400)
    return spark.createDataFrame(
        [("tone", tone(1000)), ("silence", [0.0] * 16000), ("half", quiet_then_loud),
         ("short", tone(500, 100)), ("empty", []), ("broken", [float("nan")] * 16000)],
        "arquivo string, samples array<float>")


def test_a_tone_has_its_own_centroid_and_crossings(waves):
    row = X.extract(waves.where("arquivo = 'tone'"), "arquivo", center=False).first()
    assert row["erro"] is None
    assert row["centroide_media"] == pytest.approx(1000, rel=0.02)
    assert row["zcr_media"] == pytest.approx(2 * 1000 / 16000, rel=0.02)
    assert len(row) == 46 and all(v is not None for v in list(row)[1:45])


def test_silence(waves):
    silent = waves.where("arquivo = 'silence'").withColumn("n", W.peak_normalize("samples"))
    row = X.with_series(silent, "n", "s").first()
    assert set(row["n"]) == {0.0}
    assert set(row["s"]["centroid"]) == {0.0} and set(row["s"]["zcr"]) == {0.0}


def test_normalised_peak_is_one(waves):
    for name in ("tone", "half", "short"):
        row = waves.where(F.col("arquivo") == name).select(
            W.peak(W.peak_normalize("samples")).alias("p")).first()
        assert row["p"] == pytest.approx(1.0)


def test_length_is_always_the_target(waves):
    out = waves.where("arquivo <> 'broken'").select(
        F.size(W.fix_length("samples", 64000)).alias("long"),
        F.size(W.fix_length("samples", 50)).alias("short"))
    assert {(r["long"], r["short"]) for r in out.collect()} == {(64000, 50)}
    padded = waves.where("arquivo = 'short'").select(W.fix_length("samples", 120).alias("x"))
    assert padded.first()["x"][100:] == [0.0] * 20


def test_quiet_frames_go(waves):
    out = {r["arquivo"]: r["a"] for r in waves.where("arquivo <> 'broken'").select(
        "arquivo", W.active_frames("samples", 480, 0.02).alias("a")).collect()}
    # 16,000 samples are 33 whole frames; 20 are silent, the tail is dropped
    assert len(out["half"]["samples"]) == 13 * 480
    assert out["half"]["share"] == pytest.approx(13 * 480 / 16000)
    assert out["silence"]["share"] == 0.0 and len(out["silence"]["samples"]) == 16000
    assert out["short"]["share"] == 0.0 and len(out["short"]["samples"]) == 100


def test_mix_down_is_the_mean(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 6.0]],)], "c array<array<float>>")
    assert df.select(W.mix_down("c").alias("m")).first()["m"] == [2.0, 4.0]


def test_frames_and_crossings_by_hand(spark):
    df = spark.createDataFrame([([1.0, -1.0, 1.0, 0.0, -1.0, -1.0],)], "x array<float>")
    row = df.select(W.frames("x", 4, 2).alias("f"),
                    F.transform(W.frames("x", 4, 2), W.zero_crossings).alias("z")).first()
    assert row["f"] == [[1.0, -1.0, 1.0, 0.0], [1.0, 0.0, -1.0, -1.0]]
    assert row["z"] == [0.5, 0.25]
    assert df.select(F.size(W.frames("x", 7, 2)).alias("n")).first()["n"] == 0


@pytest.mark.parametrize("center", [False, True])
def test_both_crossing_rates_agree(waves, center):
    """The expression on frames and the helper inside the Arrow call."""
    padded = W.edge_padded("samples", 200) if center else F.col("samples")
    row = waves.where("arquivo = 'half'").select(
        F.transform(W.frames(padded, 400, 256), W.zero_crossings).alias("a"),
        S.short_time("samples", center=center)["zcr"].alias("b")).first()
    assert row["a"] == pytest.approx(row["b"]) and len(row["a"]) == (63 if center else 61)


def test_centred_frames_of_a_prepared_wave(waves):
    out = X.prepare(waves.where("arquivo = 'half'"))
    row = X.with_series(out.withColumn("n", F.size("samples")), name="s",
                        keep_mel=True).first()
    assert row["n"] == 64000 and row["prop_fala"] == 0.39
    assert np.shape(row["s"]["mfcc"]) == (251, 20) and np.shape(row["s"]["mel"]) == (251, 128)
    assert len(row["s"]["zcr"]) == len(row["s"]["centroid"]) == 251


def test_filters_and_basis():
    basis = S.cosine_basis(20, 20)
    assert basis @ basis.T == pytest.approx(np.eye(20))
    filters = S.mel_filters(16000, 512, 20)
    assert filters.shape == (20, 257) and (filters >= 0).all() and (filters.sum(1) > 0).all()
    assert float(S.mel_to_hz(np.array(S.hz_to_mel(3000.0)))) == pytest.approx(3000.0)


def test_failures_are_reported_per_row(waves):
    out = {r["arquivo"]: r["erro"] for r in X.extract(X.prepare(waves), "arquivo").collect()}
    assert out["broken"].startswith("ValueError('waveform has values")
    assert out["tone"] is None and out["silence"] is None and out["short"] is None
    assert out["empty"] == "ValueError('waveform is empty')"


def test_workers_need_no_copy_of_the_package(tmp_path):
    from pyspark import cloudpickle
    (tmp_path / "f").write_bytes(cloudpickle.dumps(S.frame_spectra))
    code = "import pickle; print(pickle.load(open('f', 'rb')).__name__)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, text=True,
                          capture_output=True, env={"PATH": os.environ["PATH"]})
    assert done.stdout.strip() == "frame_spectra", done.stderr


def test_probe(waves):
    out = {r["arquivo"]: r for r in X.stage_probe(waves, "arquivo").collect()}
    assert out["half"]["raw_seconds"] == 1.0 and out["half"]["length_ok"]
    assert not out["empty"]["length_ok"]


def test_unsupported_rate(waves):
    with pytest.raises(ValueError, match="11025"):
        X.prepare(waves, rate=11025)


def test_names_in_published_order():
    names = X.feature_names()
    assert len(names) == 44 and names[0] == "mfcc1_media" and names[20] == "mfcc1_std"
    assert names[40:] == ["zcr_media", "zcr_std", "centroide_media", "centroide_std"]
