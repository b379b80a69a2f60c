"""Quality rules: a decision list learned from labelled numbers, run as one Spark expression.

The numbers of a text (words, symbols, repeats, shape) are column expressions.
Sequential covering learns rules for bad documents: conditions are added to a
rule while they gain most (FOIL's gain), the rule is cut back as far as that
helps on rows it was not grown on, the documents it covers leave, and the next
rule follows. The list becomes ``when(...).when(...).otherwise(...)``.

Defined cases: a null text has no words; a text without words has zero for
every number and fails the base rule. A ``doc_id`` with several labels takes
the smallest; null ids are judged but never fitted. Without labelled rows there
are no rules. Repeated rows are judged each; other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.quality import fit_rows
from cohortlens.llm.tables import once, table

#: Labelled documents the list is learned from at most, those with the smallest hashes.
FIT_ROWS = 8000
WINDOW = 8
MOST_RULES, MOST_CONDITIONS = 10, 3
#: A rule needs this share of bad documents among what it covers, and this many of them.
PRECISION, SUPPORT = 0.9, 4

BLANKS = r"[\x20\x09-\x0D]"
#: What the rules may look at.
RATES = ["symbol_rate", "upper_rate", "digit_rate", "bang_rate", "word_length", "dup_line_rate",
         "repeat_rate", "same_word_rate", "words_per_line"]


def text_numbers(docs: DataFrame) -> DataFrame:
    """``doc_id``, the counts of each whole text and the rates derived from them."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("_t"))
    own = once(own, F.filter(F.split("_t", BLANKS + "+"), lambda w: w != "").alias("_w"),
               F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"))
    size = F.size("_w")
    windows = F.when(size >= WINDOW, F.transform(
        F.sequence(F.lit(1), F.greatest(size - WINDOW + 1, F.lit(1))),
        lambda i: F.xxhash64(F.slice("_w", i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    own = once(own, windows.alias("_h"))

    def covered(pairs: Column) -> Column:
        """Words in windows found twice: ``pairs`` are (hash, place), sorted."""
        def twice(p: Column, j: Column) -> Column:
            return (F.coalesce(F.get(pairs, j - 1)["h"] == p["h"], F.lit(False))
                    | F.coalesce(F.get(pairs, j + 1)["h"] == p["h"], F.lit(False)))

        starts = F.array_sort(F.transform(F.filter(pairs, twice), lambda p: p["at"]))
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(starts, zero, lambda acc, at: F.struct(
            (acc["n"] + at + WINDOW - F.greatest(at, acc["end"])).alias("n"), (at + WINDOW).alias("end")),
            lambda acc: acc["n"])

    pairs = F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    repeats = F.when(F.size(F.array_distinct("_h")) < F.size("_h"),
                     F.transform(F.array(pairs), covered)[0]).otherwise(0)
    blank = F.col("_t")
    for c in (" ", "\t", "\n", "\x0b", "\x0c", "\r"):
        blank = F.replace(blank, F.lit(c), F.lit(""))
    same = F.size(F.filter("_w", lambda w, i: (i > 0) & F.coalesce(F.get("_w", i - 1) == w, F.lit(False))))
    counted = own.select(
        "doc_id", size.cast("long").alias("n_words"), F.length(blank).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeats.cast("long").alias("n_repeat_words"), F.size("_lines").alias("_n_lines"), same.alias("_same"),
        F.regexp_count("_t", F.lit("[A-Z]")).alias("_upper"), F.regexp_count("_t", F.lit("[0-9]")).alias("_digit"),
        F.regexp_count("_t", F.lit("[!?]")).alias("_bang"))

    def rate(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)

    return counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        rate("n_symbols", "word_chars").alias("symbol_rate"), rate("_upper", "word_chars").alias("upper_rate"),
        rate("_digit", "word_chars").alias("digit_rate"), rate("_bang", "word_chars").alias("bang_rate"),
        rate("word_chars", "n_words").alias("word_length"), rate("n_dup_lines", "_n_lines").alias("dup_line_rate"),
        rate("n_repeat_words", "n_words").alias("repeat_rate"), rate("_same", "n_words").alias("same_word_rate"),
        rate("n_words", "_n_lines").alias("words_per_line"))


@dataclass(frozen=True)
class Condition:
    name: str
    least: bool      # value >= limit, or else value <= limit
    limit: float

    def holds(self, row: dict) -> bool:
        return row[self.name] >= self.limit if self.least else row[self.name] <= self.limit

    def column(self) -> Column:
        return F.col(self.name) >= self.limit if self.least else F.col(self.name) <= self.limit

    def __str__(self) -> str:
        return f"{self.name} {'>=' if self.least else '<='} {self.limit:.4g}"


def counts(rows: list[dict]) -> tuple[int, int]:
    bad = sum(1 - r["y"] for r in rows)
    return bad, len(rows) - bad


def best_condition(rows: list[dict]) -> Condition | None:
    """The condition with the highest FOIL gain; equal gains go to the first name and the wider cover."""
    all_bad, all_good = counts(rows)
    if not all_bad or not all_good:
        return None
    before = math.log2(all_bad / (all_bad + all_good))
    best, best_gain = None, 1e-9
    for name in RATES:
        ordered = sorted((r[name], r["y"]) for r in rows)
        for least in (False, True):
            bad = good = 0
            walk = ordered[::-1] if least else ordered
            for i, (value, y) in enumerate(walk):
                bad, good = bad + 1 - y, good + y
                if i + 1 < len(walk) and walk[i + 1][0] == value or not bad:
                    continue
                gain = bad * (math.log2(bad / (bad + good)) - before)
                if gain > best_gain + 1e-9:
                    best, best_gain = Condition(name, least, value), gain
    return best


def grow(rows: list[dict]) -> list[Condition]:
    rule: list[Condition] = []
    while len(rule) < MOST_CONDITIONS:
        condition = best_condition(rows)
        if condition is None:
            break
        rule.append(condition)
        rows = [r for r in rows if condition.holds(r)]
    return rule


def prune(rule: list[Condition], rows: list[dict]) -> list[Condition]:
    """The beginning of the rule that is worth most on rows it was not grown on."""
    best, best_worth = rule, -2.0
    for n in range(1, len(rule) + 1):
        bad, good = counts([r for r in rows if all(c.holds(r) for c in rule[:n])])
        worth = (bad - good) / (bad + good) if bad + good else -1.0
        if worth > best_worth:
            best, best_worth = rule[:n], worth
    return best


def learn(rows: list[dict]) -> list[list[Condition]]:
    """Ordered rules for bad documents. ``rows`` have the rates, ``y`` (1: good) and ``grown``."""
    rules: list[list[Condition]] = []
    while len(rules) < MOST_RULES:
        rule = grow([r for r in rows if r["grown"]])
        if not rule:
            break
        rule = prune(rule, [r for r in rows if not r["grown"]])
        bad, good = counts([r for r in rows if all(c.holds(r) for c in rule)])
        if bad < SUPPORT or bad < PRECISION * (bad + good):
            break
        rules.append(rule)
        rows = [r for r in rows if not all(c.holds(r) for c in rule)]
    return rules


def decision_list(rules: list[list[Condition]]) -> Column:
    """The first rule that holds, as text; null where none does."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        holds = rule[0].column()
        for c in rule[1:]:
            holds = holds & c.column()
        out = F.when(holds, F.lit(" and ".join(map(str, rule)))).otherwise(out)
    return out


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> list[list[Condition]]:
    sample = fit_rows(docs, labels, "quality", rows, 1, -1)
    ys = sample.select("doc_id", F.col("_y").alias("y")).distinct()
    numbers = text_numbers(sample).select("doc_id", *RATES).join(F.broadcast(ys), "doc_id")
    grown = (F.crc32(F.concat(F.lit("grow"), F.col("doc_id").cast("string"))) % 3 != 0).alias("grown")
    return learn([r.asDict() for r in numbers.select("*", grown).orderBy("doc_id", *RATES).collect()])


def judge(docs: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return text_numbers(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), decision_list(rules).alias("rule")).withColumn(
        "kept", ~F.col("base_failed") & F.col("rule").isNull())


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, train(docs, table(spark, sf_dir, "labels")))


QUERIES = [op9_quality_rules]
ORACLES: dict[str, str] = {}
