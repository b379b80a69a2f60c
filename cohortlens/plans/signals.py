"""Waveform and series queries. The 64 values of an embedding are a short wave."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.functions import spectra as S
from cohortlens.functions import waves as W
from cohortlens.operators import features as X
from cohortlens.plans.data import six, table
from cohortlens.sources.tables import features_schema, read_table, write_table
from cohortlens.storage import scratch_path
from cohortlens.streaming import incremental as I

RATE, WIN, HOP, MELS, CEPS = 16000, 32, 16, 8, 4
SHORT = dict(rate=RATE, n_mfcc=CEPS, n_fft=WIN, hop=HOP, win=WIN, n_mels=MELS, center=False)
PREP = dict(rate=RATE, seconds=0.005, loud_rms=0.35, frame_ms=1)
BAD_WAVE = "ValueError('waveform has values that are not finite')"


def _waves(spark, sf):
    return table(spark, sf, "embeddings").select(
        "vec_id", F.col("embedding").alias("samples"), "label")


def _samples(df, *keys):
    return df.select(*keys, F.posexplode("samples").alias("pos", "value")).select(
        *keys, "pos", F.round(F.col("value").cast("double"), 6).alias("value"))


def mix_down(spark, sf):
    both = _waves(spark, sf).select("vec_id", W.mix_down(
        F.array("samples", F.reverse("samples"))).alias("samples"))
    return _samples(both, "vec_id")


def peak_normalize(spark, sf):
    return _samples(_waves(spark, sf).withColumn("samples", W.peak_normalize("samples")),
                    "vec_id")


def fix_length(spark, sf):
    both = _waves(spark, sf).select("vec_id", F.explode(F.array(
        F.struct(F.lit(40).alias("target"), W.fix_length("samples", 40).alias("samples")),
        F.struct(F.lit(80).alias("target"), W.fix_length("samples", 80).alias("samples"))))
        .alias("w")).select("vec_id", "w.target", "w.samples")
    return _samples(both, "vec_id", "target")


def frame_filter(spark, sf):
    kept = _waves(spark, sf).withColumn("a", W.active_frames("samples", 16, 0.13))
    return kept.select("vec_id", F.size("a.samples").alias("n_kept"), six("a.share")
                       .alias("share"))


def short_frames(spark, sf):
    rows = X.frame_rows(_waves(spark, sf), "vec_id", "samples", WIN, HOP)
    return rows.select("vec_id", "frame_idx", F.size("frame").alias("n"),
                       F.round(W.rms(F.col("frame")), 6).alias("rms"))


def zero_crossings(spark, sf):
    rows = X.frame_rows(_waves(spark, sf), "vec_id", "samples", WIN, HOP)
    return rows.select("vec_id", "frame_idx",
                       F.round(W.zero_crossings(F.col("frame")), 6).alias("zcr"))


def spectral_centroid(spark, sf):
    found = _waves(spark, sf).select("vec_id", S.short_time("samples", **SHORT).alias("s"))
    return found.select("vec_id", F.posexplode("s.centroid").alias("frame_idx", "c")).select(
        "vec_id", "frame_idx", F.round("c", 6).alias("centroid"))


def mfcc_features(spark, sf):
    found = _waves(spark, sf).select("vec_id", S.short_time("samples", **SHORT).alias("s"))
    return found.select("vec_id", F.posexplode("s.mfcc").alias("frame_idx", "c")).select(
        "vec_id", "frame_idx",
        *[F.round(F.col("c")[i], 6).alias(f"mfcc{i + 1}") for i in range(CEPS)])


def mel_spectrogram(spark, sf):
    found = _waves(spark, sf).select(
        "vec_id", S.short_time("samples", keep_mel=True, **SHORT).alias("s"))
    return (found.select("vec_id", F.posexplode("s.mel").alias("frame_idx", "m"))
            .select("vec_id", "frame_idx", F.posexplode("m").alias("band", "v"))
            .select("vec_id", "frame_idx", "band", F.round("v", 6).alias("db")))


def feature_vector(spark, sf):
    rows = X.extract(_waves(spark, sf), "vec_id", **SHORT)
    return rows.select("vec_id", *[F.round(F.col(c).cast("double"), 3).alias(c)
                                   for c in X.feature_names(CEPS)])


def prepared_waveform(spark, sf):
    return _samples(X.prepare(_waves(spark, sf), **PREP), "vec_id", "prop_fala")


def stage_quality_probe(spark, sf):
    return X.stage_probe(_waves(spark, sf), "vec_id", **PREP)


def series_summary(spark, sf):
    out = X.series_summary(table(spark, sf, "events"), ["user_id"], "value")
    return out.select("user_id", "n", six("mean"), six("std"))


def sign_changes(spark, sf):
    out = X.sign_changes(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"],
                         "value", centre=50.0)
    return out.select("user_id", "n", "n_changes", six("rate"))


def long_to_wide(spark, sf):
    long = X.series_summary(table(spark, sf, "events"), ["user_id", "event_type"], "value")
    wide = X.long_to_wide(long, "user_id", "event_type", "mean", ["click", "view"])
    return wide.select("user_id", *[F.round(F.coalesce(c, F.lit(0.0)), 6).alias(c)
                                    for c in ("click", "view")])


def _with_bad_waves(spark, sf):
    """Waves of one class are broken, to give the run something to fail on."""
    broken = F.array_repeat(F.lit(float("nan")).cast("float"), 64)
    return _waves(spark, sf).withColumn(
        "samples", F.when(F.col("label") == 9, broken).otherwise(F.col("samples")))


def _run(df):
    """Preparation and features, in one pass."""
    return X.extract_raw(df, "vec_id", carry=["label"], **PREP, **{k: v for k, v in SHORT.items() if k != "rate"})


def _final_state(features, errors):
    good = features.select("vec_id", F.lit("done").alias("state"), F.lit("").alias("erro"))
    return good.unionByName(errors.select("vec_id", F.lit("failed").alias("state"), "erro"))


def incremental_extract(spark, sf):
    """First a part of the waves, then all: the second run only adds the rest."""
    features, errors = scratch_path(spark, "features"), scratch_path(spark, "errors")
    waves = _with_bad_waves(spark, sf)
    I.extract_pending(waves.where(F.col("label") >= 5), features, errors, _run, "vec_id")
    I.extract_pending(waves, features, errors, _run, "vec_id")
    return _final_state(spark.read.parquet(features), spark.read.parquet(errors))


def stream_extract(spark, sf):
    """The same as a stream: files arrive in two goes, failures ride along."""
    inbox, features, errors, retry, check = (
        scratch_path(spark, n) for n in ("inbox", "features", "errors", "retry", "progress"))
    waves = _with_bad_waves(spark, sf)
    for part in (F.col("label") >= 5, F.col("label") < 5):
        write_table(waves.where(part), inbox, mode="append")
        I.stream_new_files(spark, inbox, waves.schema, features, errors, retry, check,
                           _run, "vec_id").awaitTermination()
    return _final_state(I.read_stream_features(spark, features),
                        I.latest_errors(spark, errors))


def _utterances(spark, sf):
    """Raw waves of 1,024 samples: a quiet frame, a frame with the embedding in it, and a tail."""
    def silence(n):
        return F.array_repeat(F.lit(0.0).cast("float"), n)

    wave, quiet = F.col("embedding"), F.slice(F.flatten(F.array_repeat("embedding", 8)), 1, 480)
    return table(spark, sf, "embeddings").select(
        F.format_string("LA_E_%07d", "vec_id").alias("arquivo"),
        F.when(F.col("label") == 0, "bonafide").otherwise("spoof").alias("label"),
        (F.col("label") != 0).cast("int").alias("classe_binaria"),
        F.concat(F.transform(quiet, lambda x: (x * 0.001).cast("float")), silence(150), wave, silence(266), wave).alias("samples"))


def extracted_features(spark, sf):
    """The whole extraction at its default parameters, in two runs: 44 features and the four carried columns."""
    features, errors = scratch_path(spark, "features"), scratch_path(spark, "errors")
    waves = _utterances(spark, sf)

    def run(df):
        return X.extract_raw(df, "arquivo", carry=["label", "classe_binaria"])

    I.extract_pending(waves.where("label = 'bonafide'"), features, errors, run, "arquivo")
    I.extract_pending(waves, features, errors, run, "arquivo")
    done = read_table(spark, features, features_schema())
    return done.select("arquivo", "label", "classe_binaria", "prop_fala", *[
        F.round(F.col(c).cast("double"), 3).alias(c) for c in X.feature_names()])


QUERIES = [extracted_features, mix_down, peak_normalize, fix_length, frame_filter, short_frames, zero_crossings,
           spectral_centroid, mfcc_features, mel_spectrogram, feature_vector,
           prepared_waveform, stage_quality_probe, series_summary, sign_changes,
           long_to_wide, incremental_extract, stream_extract]

_SMP = """smp AS (SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, embedding[i] AS v
  FROM embeddings, generate_series(1, 64) AS g(i))"""
_FRAMES = f"""{_SMP}, fr AS (
  SELECT vec_id, CAST(f AS INTEGER) AS frame_idx, pos - f * {HOP} AS n, CAST(v AS DOUBLE) AS v
  FROM smp, generate_series(0, 2) AS h(f)
  WHERE pos >= f * {HOP} AND pos < f * {HOP} + {WIN})"""
_ZCR = """zcr AS (
  SELECT vec_id, frame_idx, count(*) FILTER (neg <> before) / 32.0 AS zcr
  FROM (SELECT *, v < -1e-10 AS neg, lag(v < -1e-10) OVER
          (PARTITION BY vec_id, frame_idx ORDER BY n) AS before FROM fr) GROUP BY 1, 2)"""
_DFT = f"""{_FRAMES}, dft AS (
  SELECT vec_id, frame_idx, k, sqrt(power(sum(w * cos(2 * pi() * k * n / {WIN})), 2)
           + power(sum(w * sin(2 * pi() * k * n / {WIN})), 2)) AS mag
  FROM (SELECT *, v * (0.5 - 0.5 * cos(2 * pi() * n / {WIN})) AS w FROM fr),
       generate_series(0, {WIN // 2}) AS b(k) GROUP BY 1, 2, 3),
cent AS (SELECT vec_id, frame_idx, sum(mag * k * {RATE} / {WIN}) / sum(mag) AS c
         FROM dft GROUP BY 1, 2)"""
_MEL = f"""{_DFT}, edge AS (
  SELECT j, CASE WHEN m < 15 THEN m * 200.0 / 3 ELSE 1000 * exp((ln(6.4) / 27) * (m - 15)) END AS hz
  FROM (SELECT j, j * (15 + ln({RATE} / 2 / 1000.0) / (ln(6.4) / 27)) / ({MELS} + 1) AS m
        FROM generate_series(0, {MELS} + 1) AS e(j))),
tri AS (
  SELECT a.j AS band, k, greatest(0.0, least((k * {RATE} / {WIN} - a.hz) / (b.hz - a.hz),
           (c.hz - k * {RATE} / {WIN}) / (c.hz - b.hz))) * 2 / (c.hz - a.hz) AS w
  FROM edge a JOIN edge b ON b.j = a.j + 1 JOIN edge c ON c.j = a.j + 2,
       generate_series(0, {WIN // 2}) AS g(k)),
raw AS (SELECT vec_id, frame_idx, band,
               10 * log10(greatest(1e-10, sum(mag * mag * w))) AS db
        FROM dft JOIN tri USING (k) GROUP BY 1, 2, 3),
mel AS (SELECT vec_id, frame_idx, band,
               greatest(db, max(db) OVER (PARTITION BY vec_id) - 80) AS db FROM raw)"""


def _cep(c: int) -> str:
    scale = f"sqrt(2.0 / {MELS})" + (" / sqrt(2.0)" if c == 0 else "")
    return f"sum(db * cos(pi() * {c} * (2 * band + 1) / (2 * {MELS}))) * {scale}"


_CEPS = f"""{_MEL}, cep AS (
  SELECT vec_id, frame_idx, {', '.join(f'{_cep(c)} AS mfcc{c + 1}' for c in range(CEPS))}
  FROM mel GROUP BY 1, 2)"""


def _as_float(x: str, name: str) -> str:
    return f"round(CAST(CAST({x} AS FLOAT) AS DOUBLE), 3) AS {name}"


_VECTOR = ", ".join(
    [_as_float(f"avg(mfcc{i})", f"mfcc{i}_media") for i in range(1, CEPS + 1)]
    + [_as_float(f"stddev_pop(mfcc{i})", f"mfcc{i}_std") for i in range(1, CEPS + 1)]
    + [_as_float("avg(zcr)", "zcr_media"), _as_float("stddev_pop(zcr)", "zcr_std"),
       _as_float("avg(c)", "centroide_media"), _as_float("stddev_pop(c)", "centroide_std")])

_PREP = f"""{_SMP},
scaled AS (SELECT vec_id, pos, CAST(v / max(abs(v)) OVER (PARTITION BY vec_id) AS FLOAT) AS v
           FROM smp),
loud AS (SELECT vec_id, pos // 16 AS f, sqrt(avg(CAST(v AS DOUBLE) * CAST(v AS DOUBLE))) >= 0.35
         AS keep FROM scaled GROUP BY 1, 2),
kept AS (SELECT vec_id, pos, v, keep, count(*) FILTER (keep) OVER (PARTITION BY vec_id) AS n
         FROM (SELECT s.*, l.keep FROM scaled s
               JOIN loud l ON l.vec_id = s.vec_id AND l.f = s.pos // 16)),
cut AS (SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY pos) - 1 AS INTEGER)
               AS pos, v, round(n / 64.0, 4) AS prop_fala FROM kept WHERE keep OR n = 0),
shares AS (SELECT DISTINCT vec_id, prop_fala FROM cut)"""
# the same features at the default parameters. A prepared wave is silent but for the 64 samples from 150 on, so
# only the first two of its 251 frames differ from silence
_BIG = 512
_MEL_END = "(15 + ln(8.0) / (ln(6.4) / 27))"
_UTTERANCES = f"""smp AS (
  SELECT vec_id, label, CAST(i - 1 AS INTEGER) AS j,
         CAST(CAST(CAST(embedding[i] AS DOUBLE) / max(abs(CAST(embedding[i] AS DOUBLE))) OVER (PARTITION BY vec_id) AS FLOAT) AS DOUBLE) AS v
  FROM embeddings, generate_series(1, 64) AS g(i)),
fr AS (SELECT vec_id, f, 406 - 256 * f + j AS n, v FROM smp, generate_series(0, 1) AS h(f)),
dft AS (
  SELECT vec_id, f, k, sqrt(power(sum(w * cos(2 * pi() * k * n / {_BIG})), 2) + power(sum(w * sin(2 * pi() * k * n / {_BIG})), 2)) AS mag
  FROM (SELECT *, v * (0.5 - 0.5 * cos(2 * pi() * (n - 56) / 400)) AS w FROM fr WHERE n >= 56 AND n < 456),
       generate_series(0, {_BIG // 2}) AS b(k) GROUP BY 1, 2, 3),
cent AS (SELECT vec_id, f, sum(mag * k * 16000 / {_BIG}) / sum(mag) AS c FROM dft GROUP BY 1, 2),
edge AS (
  SELECT j, CASE WHEN m < 15 THEN m * 200.0 / 3 ELSE 1000 * exp((ln(6.4) / 27) * (m - 15)) END AS hz
  FROM (SELECT j, j * {_MEL_END} / 129 AS m FROM generate_series(0, 129) AS e(j))),
tri AS (
  SELECT a.j AS band, k, greatest(0.0, least((k * 31.25 - a.hz) / (b.hz - a.hz), (c.hz - k * 31.25) / (c.hz - b.hz))) * 2 / (c.hz - a.hz) AS w
  FROM edge a JOIN edge b ON b.j = a.j + 1 JOIN edge c ON c.j = a.j + 2, generate_series(0, {_BIG // 2}) AS g(k)),
raw AS (SELECT vec_id, f, band, 10 * log10(greatest(1e-10, sum(mag * mag * w))) AS db FROM dft JOIN tri USING (k) GROUP BY 1, 2, 3),
every AS (SELECT * FROM raw UNION ALL SELECT vec_id, 2, band, -100.0 FROM (SELECT DISTINCT vec_id, band FROM raw)),
mel AS (SELECT vec_id, f, band, greatest(db, max(db) OVER (PARTITION BY vec_id) - 80) AS db FROM every),
cep AS (SELECT vec_id, f, c AS i, sum(db * cos(pi() * c * (2 * band + 1) / 256)) * sqrt(2.0 / 128) / CASE WHEN c = 0 THEN sqrt(2.0) ELSE 1 END AS x
        FROM mel, generate_series(0, 19) AS q(c) GROUP BY 1, 2, 3),
sign AS (SELECT vec_id, p, below, lag(below) OVER (PARTITION BY vec_id ORDER BY p) AS before
         FROM (SELECT vec_id, 150 + j AS p, v < -1e-10 AS below FROM smp
               UNION ALL SELECT DISTINCT vec_id, q, false FROM smp, (VALUES (149), (214)) AS ends(q))),
zcr AS (SELECT vec_id, f, count(*) FILTER (below <> before AND (f = 1 OR f = 0 AND p <= 199)) / 400.0 AS x
        FROM sign, generate_series(0, 2) AS h(f) GROUP BY 1, 2),
series AS (
  SELECT vec_id, f, 'mfcc' || (i + 1) AS name, x FROM cep
  UNION ALL SELECT vec_id, f, 'zcr', x FROM zcr
  UNION ALL SELECT vec_id, f, 'centroide', c FROM cent
  UNION ALL SELECT DISTINCT vec_id, 2, 'centroide', 0.0 FROM cent),
means AS (SELECT vec_id, name, sum(x * CASE WHEN f = 2 THEN 249 ELSE 1 END) / 251 AS mean FROM series GROUP BY 1, 2),
stats AS (SELECT s.vec_id, s.name, any_value(mean) AS mean,
                 sqrt(sum((x - mean) * (x - mean) * CASE WHEN f = 2 THEN 249 ELSE 1 END) / 251) AS std
          FROM series s JOIN means m ON m.vec_id = s.vec_id AND m.name = s.name GROUP BY 1, 2)"""


def _stat(column: str) -> str:
    name, _, which = column.rpartition("_")
    value = f"max({'mean' if which == 'media' else 'std'}) FILTER (name = '{name}')"
    return f"round(CAST(CAST({value} AS FLOAT) AS DOUBLE), 3) AS {column}"


_STATE = f"""
    SELECT vec_id, CASE WHEN label = 9 THEN 'failed' ELSE 'done' END AS state,
           CASE WHEN label = 9 THEN '{BAD_WAVE.replace("'", "''")}' ELSE '' END AS erro
    FROM embeddings"""

ORACLES = {
    "extracted_features": f"""
        WITH {_UTTERANCES}
        SELECT 'LA_E_' || lpad(CAST(s.vec_id AS VARCHAR), 7, '0') AS arquivo,
               CASE WHEN any_value(e.label) = 0 THEN 'bonafide' ELSE 'spoof' END AS label,
               CAST(any_value(e.label) <> 0 AS INTEGER) AS classe_binaria, round(480 / 1024.0, 4) AS prop_fala,
               {', '.join(_stat(c) for c in X.feature_names())}
        FROM stats s JOIN embeddings e ON e.vec_id = s.vec_id GROUP BY s.vec_id""",
    "mix_down": """
        SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, round(CAST(CAST(
               (CAST(embedding[i] AS DOUBLE) + CAST(embedding[65 - i] AS DOUBLE)) / 2
               AS FLOAT) AS DOUBLE), 6) AS value
        FROM embeddings, generate_series(1, 64) AS g(i)""",
    "peak_normalize": f"""
        WITH {_SMP}
        SELECT vec_id, pos, round(CAST(CAST(CAST(v AS DOUBLE) /
               CAST(max(abs(v)) OVER (PARTITION BY vec_id) AS DOUBLE) AS FLOAT) AS DOUBLE), 6)
               AS value FROM smp""",
    "fix_length": f"""
        WITH {_SMP}
        SELECT vec_id, CAST(40 AS INTEGER) AS target, pos, round(CAST(v AS DOUBLE), 6) AS value
        FROM smp WHERE pos < 40
        UNION ALL SELECT vec_id, CAST(80 AS INTEGER), pos, round(CAST(v AS DOUBLE), 6) FROM smp
        UNION ALL SELECT vec_id, CAST(80 AS INTEGER), CAST(p AS INTEGER), 0.0
        FROM embeddings, generate_series(64, 79) AS g(p)""",
    "frame_filter": f"""
        WITH {_SMP},
        f AS (SELECT vec_id, sqrt(avg(CAST(v AS DOUBLE) * CAST(v AS DOUBLE))) >= 0.13 AS keep
              FROM smp GROUP BY vec_id, pos // 16),
        k AS (SELECT vec_id, count(*) FILTER (keep) * 16 AS n FROM f GROUP BY vec_id)
        SELECT vec_id, CAST(CASE WHEN n = 0 THEN 64 ELSE n END AS INTEGER) AS n_kept,
               round(n / 64.0, 6) AS share FROM k""",
    "short_frames": f"""
        WITH {_FRAMES}
        SELECT vec_id, frame_idx, CAST(count(*) AS INTEGER) AS n,
               round(sqrt(avg(v * v)), 6) AS rms FROM fr GROUP BY 1, 2""",
    "zero_crossings": f"""
        WITH {_FRAMES}, {_ZCR} SELECT vec_id, frame_idx, round(zcr, 6) AS zcr FROM zcr""",
    "spectral_centroid": f"""
        WITH {_DFT} SELECT vec_id, frame_idx, round(c, 6) AS centroid FROM cent""",
    "mfcc_features": f"""
        WITH {_CEPS} SELECT vec_id, frame_idx,
               {', '.join(f'round(mfcc{i}, 6) AS mfcc{i}' for i in range(1, CEPS + 1))}
        FROM cep""",
    "mel_spectrogram": f"""
        WITH {_MEL} SELECT vec_id, frame_idx, CAST(band AS INTEGER) AS band,
               round(db, 6) AS db FROM mel""",
    "feature_vector": f"""
        WITH {_CEPS}, {_ZCR}
        SELECT vec_id, {_VECTOR} FROM cep JOIN zcr USING (vec_id, frame_idx)
        JOIN cent USING (vec_id, frame_idx) GROUP BY vec_id""",
    "prepared_waveform": f"""
        WITH {_PREP}
        SELECT s.vec_id, s.prop_fala, CAST(p AS INTEGER) AS pos,
               round(CAST(coalesce(c.v, 0) AS DOUBLE), 6) AS value
        FROM shares s CROSS JOIN generate_series(0, 79) AS g(p)
        LEFT JOIN cut c ON c.vec_id = s.vec_id AND c.pos = p""",
    "stage_quality_probe": f"""
        WITH {_PREP}
        SELECT vec_id, CAST(64 AS INTEGER) AS raw_samples, 64 / 16000.0 AS raw_seconds,
               prop_fala, CAST(80 AS INTEGER) AS final_samples, true AS length_ok FROM shares""",
    "series_summary": """
        SELECT user_id, count(value) AS n, round(avg(value), 6) AS mean,
               round(stddev_pop(value), 6) AS std FROM events GROUP BY user_id""",
    "sign_changes": """
        WITH s AS (SELECT user_id, value < 50 AS below, lag(value < 50) OVER
                     (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
        SELECT user_id, count(*) AS n, count(*) FILTER (below <> before) AS n_changes,
               round(count(*) FILTER (below <> before) / count(*), 6) AS rate
        FROM s GROUP BY user_id""",
    "long_to_wide": """
        SELECT user_id, round(coalesce(avg(value) FILTER (event_type = 'click'), 0), 6) AS click,
               round(coalesce(avg(value) FILTER (event_type = 'view'), 0), 6) AS view
        FROM events GROUP BY user_id""",
    "incremental_extract": _STATE,
    "stream_extract": _STATE,
}
