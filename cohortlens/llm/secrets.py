"""Secret scans: fixed patterns, and Markov models of random strings against ordinary identifiers.

Two first-order character models are trained from labelled samples: values that
the fixed patterns find are random, other long words are ordinary. A string
whose log-likelihood ratio is high enough becomes a further span. Everything
that touches the texts is a column expression; only the table of letter pairs
(at most ``len(ALPHABET) ** 2`` rows) reaches the driver.

Defined cases: a null text counts as empty and has no spans; the digest of no
spans is that of the empty string. Without any sample both models are uniform
and add nothing. Repeated rows are scanned each; other columns are not read,
and ``redacted`` keeps them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.tables import once, table

# The patterns and least lengths that every scan finds.
KINDS = ["assign", "access", "hex", "markov"]
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Strings that the models look at: whole runs with a digit and a letter, so neither numbers nor names.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}"
SAMPLE_WORD = r"[A-Za-z0-9+/_=-]{8,}"
#: Documents that the models are trained on at most, those with the smallest hashes.
FIT_ROWS = 20_000
#: Odds against a string being random before it is looked at.
ODDS = 1e6


def _found(pattern: str, group: int, least: int) -> Column:
    """Leftmost matches of a pattern in ``_t`` with their places; those with a short ``group`` drop out.

    The places follow from the lengths of the matches and of the gaps between them.
    """
    p = F.lit(pattern)
    parts = F.arrays_zip(F.regexp_extract_all("_t", p, F.lit(0)).alias("m"),
                         F.regexp_extract_all("_t", p, F.lit(group)).alias("g"),
                         F.split("_t", pattern, -1).alias("gap"))
    span = "struct<start:int,end:int,long:int>"
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{span}>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["m"])
        made = F.struct(start.alias("start"), end.alias("end"), F.length(x["g"]).alias("long"))
        return F.struct(F.coalesce(end, start).alias("at"),
                        F.when(x["m"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(made))).alias("out"))

    spans = F.aggregate(parts, zero, step, lambda acc: acc["out"])
    return F.when(F.regexp_like("_t", p), F.filter(spans, lambda s: s["long"] >= least)).otherwise(
        F.array().cast(f"array<{span}>"))


def base_spans(docs: DataFrame) -> DataFrame:
    """Adds ``_t`` and, for each fixed kind, its spans."""
    own = once(docs, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_t"))
    return once(own, _found(ASSIGN, 2, ASSIGN_VALUE).alias("_assign"), _found(ACCESS, 0, 20).alias("_access"),
                _found(HEX, 0, 24).alias("_hex"))


def labelled_samples(docs: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """``word``, ``random`` (1 or 0) and ``n`` from at most ``rows`` documents."""
    picked = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
              .where("doc_id is not null and text is not null"))
    ids = picked.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    own = once(picked.join(F.broadcast(ids), "doc_id"), F.col("text").alias("_t"))  # bounded by ``rows``
    values = F.concat(F.regexp_extract_all("_t", F.lit(ASSIGN), F.lit(2)), F.regexp_extract_all("_t", F.lit(ACCESS), F.lit(0)),
                      F.regexp_extract_all("_t", F.lit(HEX), F.lit(0)))
    rest = F.col("_t")
    for pattern in (ASSIGN, ACCESS, HEX):
        rest = F.regexp_replace(rest, pattern, " ")
    words = F.regexp_extract_all(rest, F.lit(SAMPLE_WORD), F.lit(0))
    random = own.select(F.explode(values).alias("word"), F.lit(1).alias("random")).where("length(word) >= 16")
    plain = own.select(F.explode(words).alias("word"), F.lit(0).alias("random"))
    return random.unionByName(plain).groupBy("word", "random").agg(F.count("*").alias("n"))


def train(samples: DataFrame, weight: float = 0.5) -> list[float]:
    """For each pair of letters, in rows by the first: the log of how much likelier it is in a random string."""
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, 2)))
    counted = (samples.where(F.length("word") > 1).select("random", "n", pair.alias("pair"))
               .groupBy("random", "pair").agg(F.sum("n").alias("n")).collect())
    size = len(ALPHABET)
    seen = {(r["random"], r["pair"]): r["n"] for r in counted}
    out = []
    for a in ALPHABET:
        total = [sum(seen.get((y, a + b), 0) for b in ALPHABET) for y in (0, 1)]
        for b in ALPHABET:
            ordinary, random = ((seen.get((y, a + b), 0) + weight) / (total[y] + weight * size) for y in (0, 1))
            out.append(round(math.log(random / ordinary), 5))
    return out


def _ratio(word: Column, model: list[float]) -> Column:
    """The log-likelihood ratio of a string's letter pairs."""
    scores, size = F.lit(model), len(ALPHABET)
    letters = F.lit(ALPHABET)

    def at(i: Column) -> Column:
        return F.call_function("instr", letters, F.substring(word, i, 1))

    return F.aggregate(F.sequence(F.lit(1), F.length(word) - 1), F.lit(0.0),
                       lambda acc, i: acc + F.get(scores, (at(i) - 1) * size + at(i + 1) - 1))


def spans(docs: DataFrame, model: list[float] | None, odds: float = ODDS) -> DataFrame:
    """``docs`` with ``_t``, the fixed kinds' spans and ``_spans``: all, by start and then kind."""
    own = base_spans(docs)

    def kind(name: str) -> Column:
        number = KINDS.index(name)
        return F.transform(f"_{name}", lambda s: F.struct(s["start"].alias("start"), F.lit(number).alias("kind"), s["end"].alias("end")))

    own = once(own, F.concat(kind("assign"), kind("access"), kind("hex")).alias("_base"))
    if model is None:
        added = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    else:
        own = once(own, _found(CANDIDATE, 0, 20).alias("_maybe"))
        added = F.transform(F.filter("_maybe", lambda m: ~F.exists(
            "_base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])) & (
            _ratio(F.substring(F.col("_t"), m["start"] + 1, m["end"] - m["start"]), model) >= math.log(odds))),
            lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index("markov")).alias("kind"), m["end"].alias("end")))
    return once(own, F.array_sort("_base").alias("_base_sorted"), F.array_sort(F.concat("_base", added)).alias("_spans"))


def written(found: str) -> Column:
    """Spans as kind:start:end, joined by commas."""
    names = F.lit(KINDS)
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, model: list[float] | None, odds: float = ODDS) -> DataFrame:
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return spans(own, model, odds).select(
        "doc_id", *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(written("_base_sorted"), 256).alias("base_sha256"), written("_spans").alias("spans"),
        (F.size("_spans") - F.size("_base")).cast("long").alias("n_markov"))


def redacted(docs: DataFrame, model: list[float] | None, mark: str = "<SECRET>", odds: float = ODDS) -> DataFrame:
    """``docs`` with every span's characters replaced by ``mark``, and ``n_chars`` counted anew.

    Spans that overlap are replaced together. Texts without spans, null ones too, stay as they are.
    """
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        more = F.concat(acc["out"], F.substring(F.col("_t"), acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], more).otherwise(acc["out"]).alias("out"))

    text = F.aggregate("_spans", zero, step, lambda acc: F.concat(acc["out"], F.substring(F.col("_t"), acc["at"] + 1, F.length("_t"))))
    inside = spans(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs["text"]), model, odds)
    made = once(inside, F.when(F.size("_spans") > 0, text).otherwise(F.col("text")).alias("_new"))
    new = {"text": F.col("_new"), "n_chars": F.when(F.size("_spans") > 0, F.length("_new").cast("long")).otherwise(F.col("_row")["n_chars"])
           if "n_chars" in docs.columns else None}
    return made.select(*[new.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, train(labelled_samples(docs)))


QUERIES = [op1_secret_scans]
ORACLES: dict[str, str] = {}
