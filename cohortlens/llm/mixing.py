"""Mixing sources to target weights: iterative proportional fitting, then calibrated sampling.

Documents fall into cells by source, language and topic. The tokens of the
cells are raked: scaled to the target share of every source, then language,
then topic, again and again, until all three agree. A document is kept with a
probability in proportion to its cell's weight per token, so the expected
tokens of the sample have the target shares. The draw is a hash of the
document, so a lost executor does not change it.

Topics are the forms of text that patterns tell apart (``TOPICS``), unless a
column says otherwise. Targets are shares of tokens; by default the shares of
the input, evened out by an exponent. A value without a target, null too, keeps
its share of the input. The targets are met, so a rare value that is wanted much
can make the sample small. A caller may bound that (``most``): then no cell
counts more than so many times its tokens. What a bound, or targets that no
weights can meet, leave open is logged and returned by ``unmet``.

Defined cases: null source, language and text are values of their own (a null
or empty text has the one token that its end takes). Rows with a null
``doc_id`` are drawn by their text. Repeated rows stay or go together. An empty
table gives no rows; a target for a value that does not occur is left out and
the others share its weight. Extra columns stay.
"""

from __future__ import annotations

import logging
import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.llm.tables import table
from cohortlens.storage import BROADCAST_ROWS, materialise

LOG = logging.getLogger(__name__)
MARGINS = ["source", "lang", "topic"]
#: Topic and pattern; the first that is found counts.
TOPICS = [("notice", r"(?i)licen[cs]e|copyright|all rights reserved"), ("table", r" \| "),
          ("marks", r"[#*$%&]{3}"), ("shout", r"!!")]
OTHER_TOPIC = "prose"
#: Exponents of the default targets: 1 leaves the shares as they are, 0 makes them equal.
EVEN = {"source": 0.7, "lang": 0.7, "topic": 1.0}
#: Rounds between two writes, and how far a margin's share may be off in the end.
ROUNDS, TOLERANCE = 5, 1e-6
#: How many times its own share of the tokens a cell may count at most; not bounded unless a caller asks.
MOST = math.inf
#: Margins that are off by more than this are logged.
LOGGED = 1e-4
SEED = 17


def topic_of(text: Column) -> Column:
    out = F.lit(OTHER_TOPIC)
    for name, pattern in reversed(TOPICS):
        out = F.when(F.coalesce(text.rlike(pattern), F.lit(False)), F.lit(name)).otherwise(out)
    return out


def token_count(text: Column) -> Column:
    """Words and the end of the text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long") + 1


def cells(docs: DataFrame) -> DataFrame:
    """Tokens and documents of each source, language and topic. ``docs`` has the columns ``_cell`` and ``_tokens``."""
    return docs.groupBy("_cell").agg(F.sum("_tokens").alias("tokens"), F.count("*").alias("documents")) \
        .select("_cell.*", "tokens", "documents")


def even_targets(found: DataFrame, exponents: dict[str, float] = EVEN) -> DataFrame:
    """``margin``, ``value``, ``share``: each margin's shares of tokens, raised to its exponent."""
    each = [found.groupBy(F.col(m).alias("value")).agg(F.sum("tokens").alias("t")).select(
        F.lit(m).alias("margin"), "value", F.pow(F.col("t").cast("double"), F.lit(float(exponents[m]))).alias("w")) for m in MARGINS]
    return with_shares(reduce(DataFrame.unionByName, each))


def with_shares(weights: DataFrame) -> DataFrame:
    total = weights.groupBy("margin").agg(F.sum("w").alias("_all"))
    return weights.join(F.broadcast(total), "margin").select("margin", "value", (F.col("w") / F.col("_all")).alias("share"))


def settled_targets(found: DataFrame, targets: DataFrame) -> DataFrame:
    """``targets`` for the values that occur; those without one keep their share of the input."""
    parts, total = [], float(found.agg(F.sum("tokens")).first()[0] or 1)
    for m in MARGINS:
        own = found.groupBy(F.col(m).alias("value")).agg(F.sum("tokens").alias("t"))
        share = F.col("t") / F.lit(total)
        wanted = targets.where(F.col("margin") == m).select(F.col("value").alias("_v"), "share")
        parts.append(own.select("value", share.alias("own")).join(wanted, F.col("value").eqNullSafe(F.col("_v")), "left")
                     .select(F.lit(m).alias("margin"), "value", "own", "share"))
    every = reduce(DataFrame.unionByName, parts)
    kept = every.groupBy("margin").agg(F.sum(F.when(F.col("share").isNull(), F.col("own")).otherwise(0.0)).alias("_kept"),
                                       F.sum("share").alias("_asked"))
    return every.join(F.broadcast(kept), "margin").select(
        "margin", "value", F.when(F.col("share").isNull(), F.col("own")).otherwise(
            F.col("share") / F.col("_asked") * (1 - F.col("_kept"))).alias("share"))


def rake(found: DataFrame, targets: DataFrame, tolerance: float = TOLERANCE, most: float = MOST) -> DataFrame:
    """The cells with ``weight``: tokens scaled until every margin has its target share.

    A cell carries its three targets, so a round is a window for each margin and joins nothing. Few cells are
    held in one partition, where no window moves a row; every ``ROUNDS`` rounds the weights are written out, so
    the plan does not grow. It ends when no margin's share is off by more than ``tolerance``, or when no margin
    comes nearer. ``most`` bounds a cell's weight to so many times its share of the tokens.
    """
    now = found.withColumn("weight", F.col("tokens") / F.lit(float(found.agg(F.sum("tokens")).first()[0] or 1)))
    now = now.withColumn("bound", F.col("weight") * most if most < math.inf else F.lit(None).cast("double"))
    for m in MARGINS:
        wanted = targets.where(F.col("margin") == m).select(F.col("value").alias("_v"), F.col("share").alias(f"_to_{m}"))
        now = now.join(wanted, F.col(m).eqNullSafe(F.col("_v"))).drop("_v")
    now, last = materialise(now, "cells"), None
    few = now.count() <= BROADCAST_ROWS
    while True:
        now = now.repartition(1) if few else now
        for _ in range(ROUNDS):
            off = F.lit(0.0)
            for m in MARGINS:
                have = f"_have_{m}"
                now = now.withColumn(have, F.sum("weight").over(Window.partitionBy(m)))
                scaled = F.when(F.col(have) > 0, F.col("weight") * F.col(f"_to_{m}") / F.col(have)).otherwise(0.0)
                now = now.withColumn("weight", F.least(scaled, "bound"))  # no bound: null, which least leaves out
                off = F.greatest(off, F.abs(F.col(f"_to_{m}") - F.col(have)))
            now = now.withColumn("off", off).drop(*[f"_have_{m}" for m in MARGINS])
        now = materialise(now, "cells")
        off = now.agg(F.max("off")).first()[0]
        if off is None or off <= tolerance or last is not None and last - off <= tolerance / 10:
            return now.select(*MARGINS, "tokens", "documents", "weight")
        now, last = now.drop("off"), off


def unmet(raked: DataFrame, targets: DataFrame, tolerance: float = LOGGED) -> DataFrame:
    """``margin``, ``value``, the target ``share`` and what was ``reached``, where they differ by more than ``tolerance``."""
    whole = raked.agg(F.sum("weight").alias("_all"))
    each = [raked.groupBy(F.col(m).alias("_v")).agg(F.sum("weight").alias("_w")).select(F.lit(m).alias("_m"), "_v", "_w") for m in MARGINS]
    reached = reduce(DataFrame.unionByName, each).crossJoin(F.broadcast(whole)).select(
        "_m", "_v", F.when(F.col("_all") > 0, F.col("_w") / F.col("_all")).otherwise(0.0).alias("reached"))
    return targets.join(reached, (F.col("margin") == F.col("_m")) & F.col("value").eqNullSafe(F.col("_v"))).select(
        "margin", "value", "share", "reached").where(F.abs(F.col("share") - F.col("reached")) > tolerance)


def probabilities(raked: DataFrame) -> DataFrame:
    """``_cell`` and ``p``: weight per token, scaled so that the most wanted cell is kept whole."""
    ratio = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0)
    most = raked.agg(F.max(ratio)).first()[0] or 1.0
    return raked.select(F.struct(*MARGINS).alias("_cell"), F.least(ratio / F.lit(most), F.lit(1.0)).alias("p"))


def celled(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), F.struct(
        F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
        (topic_of(text) if topic is None else topic).alias("topic")).alias("_cell"),
        token_count(text).alias("_tokens"),
        F.when(F.col("doc_id").isNull(), F.xxhash64(text, F.lit(SEED))).otherwise(
            F.xxhash64(F.col("doc_id").cast("long"), F.lit(SEED))).alias("_number"))


def mix(docs: DataFrame, targets: DataFrame | None = None, topic: Column | None = None, most: float = MOST):
    """The cells with their probabilities, and ``docs`` as rows of ``_row``, ``_cell``, ``_tokens``, ``p``, ``kept``."""
    every = celled(docs, topic)
    found = materialise(cells(every), "cells")
    targets = even_targets(found) if targets is None else targets
    settled = materialise(settled_targets(found, targets), "targets")
    raked = rake(found, settled, most=most)
    missed = unmet(raked, settled).orderBy(F.abs(F.col("share") - F.col("reached")).desc())
    for r in missed.limit(20).collect():
        LOG.warning("mixing: %s %r has %.6f of the tokens, the target is %.6f", r["margin"], r["value"], r["reached"], r["share"])
    p = materialise(probabilities(raked), "probabilities")
    # a uniform number from 53 bits of the hash
    draw = F.pmod("_number", F.lit(1 << 53)) / F.lit(float(1 << 53))
    fields = [F.col(f"_cell.{m}").eqNullSafe(F.col(f"_p.{m}")) for m in MARGINS]
    side = p.select(F.col("_cell").alias("_p"), "p")
    joined = every.join(side, reduce(lambda a, b: a & b, fields))
    return raked, joined.withColumn("kept", draw < F.col("p"))


def sample(docs: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` that are drawn, unchanged."""
    return mix(docs, targets)[1].where("kept").select("_row.*")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's cell, tokens, probability and whether it is drawn."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mix(docs)[1].select(F.col("_row.doc_id").cast("long").alias("doc_id"), "_cell.*",
                               F.col("_tokens").alias("n_tokens"), F.col("p").alias("probability"), "kept")


QUERIES = [op2_mixing]
ORACLES: dict[str, str] = {}
