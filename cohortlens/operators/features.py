"""From a waveform table to one fixed-length feature row per waveform."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens import constants as K
from cohortlens.functions import spectra as S
from cohortlens.functions import utterances as U
from cohortlens.functions import waves as W
from cohortlens.operators.ordering import previous_in_order

LOUD_RMS = 0.02


def feature_names(n_mfcc: int = K.N_MFCC) -> list[str]:
    """The published order: cepstral means, their deviations, then the rest."""
    return ([f"mfcc{i}_media" for i in range(1, n_mfcc + 1)]
            + [f"mfcc{i}_std" for i in range(1, n_mfcc + 1)]
            + ["zcr_media", "zcr_std", "centroide_media", "centroide_std"])


def series_summary(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Frame count, mean and population deviation of a series per key."""
    return df.groupBy(*by).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"))


def sign_changes(df: DataFrame, by: Sequence[str], order: Sequence[str],
                 value: str, centre: float | Column = 0.0) -> DataFrame:
    """Rate of sign changes between consecutive rows of each series.

    For series stored as rows; a stored array uses ``waves.zero_crossings``.
    ``order`` must be unique within the table.
    """
    rows = df.select(*by, *order, (F.col(value) < centre).alias("_below"))
    pairs = previous_in_order(rows, by, order, F.col("_below"), "_before")
    changed = F.coalesce((F.col("_below") != F.col("_before")).cast("int"), F.lit(0))
    return (pairs.withColumn("_changed", changed).groupBy(*by)
            .agg(F.count("*").alias("n"), F.sum("_changed").alias("n_changes"))
            .withColumn("rate", F.col("n_changes") / F.col("n")))


def long_to_wide(df: DataFrame, key: str, name: str, value: str,
                 names: Sequence[str]) -> DataFrame:
    """One column per listed name; the list keeps the job to a single pass."""
    return df.groupBy(key).pivot(name, list(names)).agg(F.first(value))


def frame_rows(df: DataFrame, id_col: str, samples: str, win: int = K.WIN,
               hop: int = K.HOP) -> DataFrame:
    return df.select(id_col, F.posexplode(W.frames(samples, win, hop))
                     .alias("frame_idx", "frame"))


def prepare(df: DataFrame, samples: str = "samples", rate: int = K.SAMPLE_RATE,
            seconds: float = K.SECONDS, vad: bool = True,
            loud_rms: float = LOUD_RMS, frame_ms: int = K.VAD_FRAME_MS) -> DataFrame:
    """Scale, drop quiet frames, fix the length; adds the kept share.

    The order matters: the loudness rule needs scaled samples, and padding must
    come after the quiet frames are gone. A waveform given as channels is mixed
    down first. Null or empty waveforms stay null.
    """
    kind = df.schema[samples].dataType
    mono = df
    if kind.simpleString().startswith("array<array<"):
        mono = df.withColumn(samples, W.mix_down(samples))
    usable = F.when(F.size(samples) > 0, F.col(samples))
    scaled = mono.withColumn(samples, W.peak_normalize(usable))
    if vad:
        if rate not in K.VAD_RATES:
            raise ValueError(f"sample rate {rate} is not one of {K.VAD_RATES}")
        active = W.active_frames(samples, int(rate * frame_ms / 1000), loud_rms)
        scaled = (scaled.withColumn("_active", active)
                  .withColumn(samples, F.col("_active.samples"))
                  .withColumn("prop_fala", F.round("_active.share", 4)).drop("_active"))
    else:
        scaled = scaled.withColumn("prop_fala", F.lit(1.0))
    return scaled.withColumn(samples, W.fix_length(samples, int(rate * seconds)))


def with_series(df: DataFrame, samples: str = "samples", name: str = "series",
                **params) -> DataFrame:
    """Add the short-time series of a waveform column, however it was made.

    The planner would merge the expressions behind ``samples`` into the call of
    the Python function, and cannot run that when they hold nested lambdas.
    Unpacking a one-element array keeps the two steps apart.
    """
    wave = F.coalesce(F.col(samples), F.array().cast("array<float>"))
    return (df.select("*", F.explode(F.array(wave)).alias("_wave"))
            .withColumn(name, S.short_time("_wave", **params)).drop("_wave"))


def extract(df: DataFrame, id_col: str, samples: str = "samples",
            carry: Sequence[str] = (), rate: int = K.SAMPLE_RATE,
            n_mfcc: int = K.N_MFCC, n_fft: int = K.N_FFT, hop: int = K.HOP,
            win: int = K.WIN, n_mels: int = K.N_MELS, center: bool = True) -> DataFrame:
    """One row per waveform: id, carried columns, the feature vector, ``erro``.

    Frames are summarised by a plain aggregate. All frames of a waveform come
    from one row, so the partial aggregate already yields one record per
    waveform and only that is shuffled. The id must be unique.
    """
    found = with_series(df, samples, "_series", rate=rate, n_mfcc=n_mfcc, n_fft=n_fft,
                        hop=hop, win=win, n_mels=n_mels, center=center)
    # for odd lengths the last crossing frame may have no spectrum, or the other way
    series = F.arrays_zip(*[F.col(f"_series.{n}").alias(n)
                            for n in ("mfcc", "centroid", "zcr")])
    frames = found.select(
        id_col, *carry, F.col("_series.erro").alias("erro"),
        F.explode_outer(series).alias("_f"))
    coef = [F.col("_f.mfcc")[i] for i in range(n_mfcc)]

    def summary(make, tag: str) -> list[Column]:
        return [make(c).cast("float").alias(f"mfcc{i}_{tag}")
                for i, c in enumerate(coef, start=1)]

    others = [make(F.col(f"_f.{source}")).cast("float").alias(f"{name}_{tag}")
              for source, name in (("zcr", "zcr"), ("centroid", "centroide"))
              for make, tag in ((F.avg, "media"), (F.stddev_pop, "std"))]
    return frames.groupBy(id_col, *carry, "erro").agg(
        *summary(F.avg, "media"), *summary(F.stddev_pop, "std"), *others,
    ).select(id_col, *carry, *feature_names(n_mfcc), "erro")


def extract_raw(df: DataFrame, id_col: str, samples: str = "samples", carry: Sequence[str] = (),
                rate: int = K.SAMPLE_RATE, seconds: float = K.SECONDS, vad: bool = True,
                loud_rms: float = LOUD_RMS, frame_ms: int = K.VAD_FRAME_MS, n_mfcc: int = K.N_MFCC,
                n_fft: int = K.N_FFT, hop: int = K.HOP, win: int = K.WIN, n_mels: int = K.N_MELS,
                center: bool = True, top_db: float | None = S.TOP_DB) -> DataFrame:
    """From raw waveforms to id, carried columns, ``prop_fala``, the features and ``erro``, without a shuffle.

    The same numbers as ``extract`` on ``prepare``, in one Arrow pass: a wave goes to Python once and only
    its row comes back. Ids need not be unique. A wave that fails has ``erro`` and no features; null and
    empty waves, samples that are null or not finite, and channels of different lengths fail.
    """
    if vad and rate not in K.VAD_RATES:
        raise ValueError(f"sample rate {rate} is not one of {K.VAD_RATES}")
    names, kept = feature_names(n_mfcc), [id_col, *carry]
    run = U.extractor(kept, names, rate, seconds, vad, loud_rms, frame_ms, K.SILENT_PEAK, n_mfcc, n_fft, hop, win,
                      n_mels, center, top_db)
    own = df.select(*kept, F.col(samples).alias("_wave"))
    schema = T.StructType([*own.drop("_wave").schema.fields, T.StructField("prop_fala", T.DoubleType()),
                           *[T.StructField(c, T.FloatType()) for c in names], T.StructField("erro", T.StringType())])
    return own.mapInArrow(run, schema).withColumn("prop_fala", F.round("prop_fala", 4))


def stage_probe(df: DataFrame, id_col: str, samples: str = "samples",
                rate: int = K.SAMPLE_RATE, seconds: float = K.SECONDS,
                **options) -> DataFrame:
    """Raw length, raw seconds, kept share and whether the final length is right."""
    raw = df.withColumn("raw_samples", F.size(samples))
    done = prepare(raw, samples, rate, seconds, **options)
    return done.select(
        id_col, "raw_samples", (F.col("raw_samples") / rate).alias("raw_seconds"),
        "prop_fala", F.size(samples).alias("final_samples"),
        (F.size(samples) == int(rate * seconds)).alias("length_ok"))
