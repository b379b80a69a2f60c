"""Metrics of many positive groups against one shared set of negatives.

Pairing every group with all negatives would copy the negatives once per group.
Only the equal error rate needs the pairing, and it looks at one place of the
curve: where the falling miss rate meets the rising false-alarm rate. Both
rates only move one way, so totals by range of score tell where that is:

1. scores are cut into slots, and rows are counted by slot: positives by group,
   negatives once. That moves counts, not rows;
2. running totals of these say in which slot each group's curve crosses;
3. only that slot and its neighbours are opened: their rows give the curve's
   points around the crossing. Where the kept points lie further away, because
   all steps of the curve are alike there, more slots are opened, twice as many
   each time.

There are four times as many slots as groups, so what the groups open together
is about as much as the table. The result equals the full pairing for every
group, wherever the slots are cut.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions import decisions as D
from cohortlens.functions.rates import ratio
from cohortlens.operators.ordering import POINTS, even_quantiles, running_totals, slot_of
from cohortlens.storage import materialise

#: Most cuts between slots, and rows that a slot should hold.
MOST_POINTS, SLOT_ROWS = 16_383, 100_000


def _over(tp: Column, fp: Column, all_pos: Column, all_neg: int) -> Column:
    """The curve is past its crossing: fewer misses than false alarms, in whole numbers."""
    big = "decimal(38,0)"
    return fp.cast(big) * all_pos.cast(big) > F.lit(all_neg).cast(big) * (all_pos - tp).cast(big)


def _slotted(rows: DataFrame, points: int) -> tuple[DataFrame, int, int]:
    """``rows`` with the ``slot`` of their score, from the highest down, the number of slots, and that of negatives.

    The cuts are quantiles, at most ``points`` numbers, or four a group, or one for ``SLOT_ROWS`` rows, fixed once:
    counting and opening use the same. Any cuts give the same result, so an eighth of the scores is enough.
    """
    some = F.when(F.pmod(F.xxhash64("score"), F.lit(8)) == 0, F.col("score").cast("double"))
    rows = rows.withColumn("_some", some)
    first = rows.agg(even_quantiles("_some", points).alias("cuts"), F.approx_count_distinct("group").alias("groups"),
                     F.count("*").alias("n"), F.count_if(F.col("group").isNull()).alias("neg")).first()
    found, wanted = first["cuts"], min(MOST_POINTS, max(4 * first["groups"], first["n"] // SLOT_ROWS))
    if wanted > points:
        found = rows.agg(even_quantiles("_some", wanted)).first()[0]
    inner = sorted({c for c in found or [0.0] if math.isfinite(c)} or {0.0})
    cut = Bucketizer(splits=[-math.inf, *inner, math.inf], inputCol="_score", outputCol="_bucket")
    out = cut.transform(rows.withColumn("_score", F.col("score").cast("double")))
    return out.select("group", "score", (len(inner) - F.col("_bucket").cast("int")).alias("slot")), len(inner) + 1, first["neg"]


def _negative_ends(totals: DataFrame, slots: int) -> DataFrame:
    """One row, one array: the negatives' running total at the end of every slot."""
    by_slot = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row a slot
    every = totals.sparkSession.range(slots).select(F.col("id").cast("int").alias("slot"))
    line = every.join(totals.where("group is null").select("slot", "n"), "slot", "left").select(
        "slot", F.sum(F.coalesce("n", F.lit(0))).over(by_slot).alias("fp"))
    return line.agg(F.sort_array(F.collect_list(F.struct("slot", "fp")))["fp"].alias("_ends"))


def _crossings(totals: DataFrame, ends: DataFrame, all_neg: int, slots: int) -> DataFrame:
    """For each group its positives and the slot at whose end its curve is first past the crossing.

    ``totals`` counts rows by ``group`` (null: negatives) and ``slot``. Between two slots with positives
    only negatives are added, and how many it takes there is a search in their running totals.
    """
    own = Window.partitionBy("group").orderBy("slot")
    pos = totals.where("group is not null").select(
        "group", "slot", F.sum("n").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("tp"),
        F.sum("n").over(Window.partitionBy("group")).alias("all_pos"),
        F.lead("slot").over(own).alias("_next"), (F.row_number().over(own) == 1).alias("_first"))
    steps = F.array(*[F.struct(F.when(F.col("_first"), F.lit(0)).alias("start"), F.lit(0).cast("bigint").alias("tp"),
                               F.col("slot").alias("stop")),
                      F.struct(F.col("slot").alias("start"), F.col("tp").alias("tp"),
                               F.coalesce("_next", F.lit(slots)).alias("stop"))])
    runs = pos.select("group", "all_pos", F.explode(steps).alias("_s")).select("group", "all_pos", "_s.*").where(
        "start is not null and start < stop").withColumn("_ends", ends.scalar())
    # fewest false alarms that are past the crossing with so many positives
    need = F.floor(F.lit(all_neg).cast("decimal(38,0)") * (F.col("all_pos") - F.col("tp")).cast("decimal(38,0)")
                   / F.col("all_pos").cast("decimal(38,0)")).cast("bigint") + 1
    at = F.greatest(slot_of(need, F.col("_ends"), slots), F.col("start"))
    crossed = runs.withColumn("_at", at).groupBy("group", "all_pos").agg(
        F.min(F.when(F.col("_at") < F.col("stop"), F.col("_at"))).alias("slot"))
    # a curve that ends with as many misses as false alarms is nowhere past it
    return crossed.select("group", "all_pos", F.coalesce("slot", F.lit(slots - 1)).cast("int").alias("slot"))


def _opened(rows: DataFrame, totals: DataFrame, ends: DataFrame, ranges: DataFrame, all_neg: int, points: int = 0) -> DataFrame:
    """The best kept point of each group within its ``low`` to ``high`` slots; ``left`` and ``right`` say
    whether there is a kept point before and after the crossing.

    Without ``points`` a group's few open slots are one window; with them the order is cut into slots of its own.
    """
    slot = F.explode(F.sequence("low", "high")).alias("slot")
    wanted = ranges.select("group", slot)
    zero = F.lit(0).cast("bigint")
    used = wanted.select("slot").distinct()  # one row a slot at most
    near = rows.join(F.broadcast(used), "slot").groupBy("group", "slot", "score").agg(F.count("*").alias("n"))
    near = materialise(near, "open-rows")
    own = near.where("group is not null").join(wanted, ["group", "slot"]).select("group", "score", F.col("n").alias("m"), zero.alias("n"))
    neg = near.where("group is null").drop("group").join(wanted, "slot").select("group", "score", zero.alias("m"), "n")
    hist = own.unionByName(neg).groupBy("group", "score").agg(F.sum("m").alias("m"), F.sum("n").alias("n"))
    base = ranges.join(totals.where("group is not null").withColumnRenamed("slot", "_slot"), "group").where(
        F.col("_slot") < F.col("low")).groupBy("group").agg(F.sum("n").alias("_tp"))
    around = ranges.join(base, "group", "left").withColumn("_ends", ends.scalar()).select(
        "group", "all_pos", "low", "high", F.coalesce("_tp", zero).alias("_tp"),
        F.when(F.col("low") > 0, F.try_element_at("_ends", F.col("low"))).otherwise(zero).alias("_fp"))
    if points:
        curve = running_totals(hist, "score", ["m", "n"], ["group"], descending=True, points=points, follow=True)
    else:
        order = Window.partitionBy("group").orderBy(F.desc("score"))
        so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        curve = hist.select("*", *[F.sum(c).over(so_far).alias(f"cum_{c}") for c in ("m", "n")],
                            *[F.lead(c).over(order).alias(f"next_{c}") for c in ("m", "n")])
    at = curve.join(around, "group").select(
        "group", "all_pos", "score", "m", "n", "next_m", "next_n",
        (F.col("_tp") + F.col("cum_m")).alias("tp"), (F.col("_fp") + F.col("cum_n")).alias("fp"))
    size = F.col("tp") + F.col("fp")
    last = size == F.col("all_pos") + all_neg
    # the last opened point is known to be kept only where the curve ends
    bend = (size == F.col("m") + F.col("n")) | last | (
        F.col("next_m").isNotNull() & ((F.col("next_m") != F.col("m")) | (F.col("next_n") != F.col("n"))))
    none = F.lit(None).cast(rows.schema["score"].dataType)
    anchor = around.where("_tp + _fp = 0").select("group", "all_pos", none.alias("score"), zero.alias("tp"), zero.alias("fp"))
    kept = at.where(bend).select("group", "all_pos", "score", "tp", "fp").unionByName(anchor)
    fpr, fnr = ratio(F.col("fp"), F.lit(all_neg)), 1 - ratio(F.col("tp"), F.col("all_pos"))
    past = _over(F.col("tp"), F.col("fp"), F.col("all_pos"), all_neg)
    best = kept.groupBy("group").agg(
        F.min_by(F.struct(((fpr + fnr) / 2).alias("eer"), F.col("score").alias("eer_threshold")),
                 F.struct(F.abs(fnr - fpr), size)).alias("_b"),
        F.max(~past).alias("_left"), F.max(past | last).alias("_right"))
    return ranges.join(best, "group", "left").select(
        "group", "all_pos", "low", "high", "_b.*", F.coalesce("_left", F.lit(False)).alias("left"),
        F.coalesce("_right", F.lit(False)).alias("right"))


def shared_negative_eer(df: DataFrame, group: str, label: str, score: str,
                        points: int = POINTS) -> DataFrame:
    """``group, eer, eer_threshold``: the group's positives and all negatives."""
    kind = df.schema[score].dataType
    rows = df.where(F.col(score).isNotNull())
    if kind.typeName() in ("double", "float"):
        rows = rows.where(~F.isnan(score))
    named = F.when(F.col(label) == 1, F.col(group))
    rows = rows.where((F.col(label) == 0) | named.isNotNull()).select(named.alias("group"), F.col(score).alias("score"))
    rows, slots, all_neg = _slotted(rows, points)
    totals = materialise(rows.groupBy("group", "slot").agg(F.count("*").alias("n")), "slot-totals")
    kinds = totals.where("group is not null").select("group").distinct()
    if not all_neg:
        none = [F.lit(None).cast("double").alias("eer"), F.lit(None).cast(kind).alias("eer_threshold")]
        return kinds.select(F.col("group").alias(group), *none)
    ends = materialise(_negative_ends(totals, slots), "slot-ends")
    ranges = _crossings(totals, ends, all_neg, slots).select(
        "group", "all_pos", F.greatest(F.col("slot") - 1, F.lit(0)).alias("low"),
        F.least(F.col("slot") + 1, F.lit(slots - 1)).alias("high"))
    done, more = None, 2
    while True:
        found = materialise(_opened(rows, totals, ends, materialise(ranges, "ranges"), all_neg, points if done else 0), "opened")
        part = found.where("left and right").select("group", "eer", "eer_threshold")
        done = part if done is None else done.unionByName(part)
        rest = found.where("not (left and right)")
        if rest.isEmpty():
            return done.withColumnRenamed("group", group)
        ranges = rest.select(
            "group", "all_pos",
            F.when(F.col("left"), F.col("low")).otherwise(F.greatest(F.col("low") - more, F.lit(0))).alias("low"),
            F.when(F.col("right"), F.col("high")).otherwise(F.least(F.col("high") + more, F.lit(slots - 1))).alias("high"))
        more *= 2


def shared_negative_report(df: DataFrame, group: str, label: str, predicted: str,
                           score: str, negatives: str = "bonafide",
                           points: int = POINTS) -> DataFrame:
    """One row per positive group and one for the negatives.

    Columns: group, rows, recall, F1 against all negatives, mean score, equal
    error rate. The negatives' row has their own recall and no F1 or rate.
    """
    pred = F.col(predicted)
    pos = (df.where((F.col(label) == 1) & F.col(group).isNotNull()).groupBy(group).agg(
        F.count("*").alias("n"), F.count_if(pred == 1).alias("_tp"),
        F.avg(score).alias("mean_score")))
    neg = df.where(F.col(label) == 0).agg(
        F.count("*").alias("n"), F.count_if(pred == 1).alias("_fp"),
        F.avg(score).alias("mean_score"))
    shared_fp = neg.select("_fp").scalar()
    tp, fn = F.col("_tp"), F.col("n") - F.col("_tp")
    own = (pos.join(shared_negative_eer(df, group, label, score, points), group, "left")
           .select(F.col(group).cast("string").alias(group), "n",
                   D.recall(tp, fn).alias("recall"),
                   D.f1(tp, shared_fp, fn).alias("f1_shared"), "mean_score",
                   F.col("eer").alias("eer_shared")))
    none = F.lit(None).cast("double")
    row = neg.select(
        F.lit(negatives).alias(group), "n",
        D.recall(F.col("n") - F.col("_fp"), F.col("_fp")).alias("recall"),
        none.alias("f1_shared"), "mean_score", none.alias("eer_shared"))
    return own.unionByName(row)
