"""Spelling variant grouping: words one edit apart, found by pivotal bigrams.

All bigrams of the vocabulary stand in one order, rare ones first. A word's
prefix is its three rarest bigram places and every other place of a bigram no
more frequent than they are; two of the prefix that do not overlap, chosen by
dynamic programming for the least number of words they lead to, are its
pivots. One edit spoils at most one of two disjoint bigrams. So of two words
one edit apart, the one whose prefix ends earlier in the order has a pivot that
survives in the other word, and there it lies in the prefix. Pivots are joined
with prefixes by bigram, and by the places that one edit allows: the same one
in words of equal length, the same or the next one in a longer word. What is
joined is verified: first by the letters that occur an odd number of times
(one replaced letter changes two of them, one more letter changes one), then by
the edit distance itself.

The vocabulary comes from all texts. A word's occurrences are counted per task
before they are shuffled. Words that lead to another one, their forms, are
followed by doubling the way.

Defined cases: a null or empty text has no words. A null ``doc_id`` counts as
an empty one where occurrences are altered. Repeated rows count each. A run of
any length is one word, and takes memory in proportion to its length. Equally
frequent forms: the smaller in code-point order. An empty table gives no rows.
Other columns of the input are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.tables import pieces, table
from cohortlens.storage import broadcast_if_small, materialise

LEAST_LENGTH, LEAST_COUNT = 6, 5
#: A form occurs at least so many times as often as its variant.
TIMES = 5
#: One of so many occurrences loses a letter.
ALTERED = 199
#: A maximal run that is long enough to give a word.
RUN = re.compile(r"[A-Za-zÀ-ÿ]{%d,}" % LEAST_LENGTH)
#: Distinct words, and code points in them, that a task holds before it hands them on.
HELD, HELD_POINTS = 300_000, 8_000_000
#: Places of a word's prefix: one edit spoils up to two of them, so one stays.
PREFIX, PIVOTS = 3, 2


def altered_counts(doc_id: str, text: bytes) -> Iterator[tuple[str, int]]:
    """The words of one text and how often each occurs, the occurrences of some runs altered.

    All occurrences of a run in one document are altered alike, as only both of them decide.
    """
    start = zlib.crc32(f"{doc_id}:".encode())
    for run, n in Counter(RUN.findall(text.lower().decode("utf-8", "replace"))).items():  # lowers A-Z only
        h = zlib.crc32(run.encode(), start)
        if h % ALTERED == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
            if len(run) < LEAST_LENGTH:
                continue
        yield run, n


def vocabulary(docs: DataFrame) -> DataFrame:
    """``word`` and ``n``: words that are long and frequent enough, over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        points = 0

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())],
                                             names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for part in pieces(batch, "text"):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    for word, n in altered_counts(doc_id, text or b""):
                        if word not in held:
                            points += len(word)
                        held[word] += n
                    if len(held) > HELD or points > HELD_POINTS:
                        yield rows()
                        points = 0
        if held:
            yield rows()

    own = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"),
                      F.col("text").cast("binary").alias("text"))
    return own.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(
        F.col("n") >= LEAST_COUNT)


def odd_letters() -> Column:
    """A bit for each of 64 classes of letters: whether ``word`` holds an odd number of them."""
    bits = F.transform(F.split("word", ""), lambda c: F.call_function(
        "shiftleft", F.lit(1).cast("long"), F.pmod(F.ascii(c), F.lit(64)).cast("int")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseXOR(b))


def pivots_of(prefix: list[tuple[int, int]]) -> list[int]:
    """Which ``PIVOTS`` places of a prefix to take: disjoint ones that lead to the fewest words.

    ``prefix`` holds each place and how many words its bigram leads to, by place. ``best[j]`` is the least sum of
    j places so far; a place joins the best choice among those that end before it.
    """
    best: list[list[tuple[int, list[int]] | None]] = [[(0, [])] + [None] * PIVOTS]
    for i, (place, leads) in enumerate(prefix):
        before = next((k + 1 for k in range(i - 1, -1, -1) if prefix[k][0] <= place - 2), 0)
        now = list(best[-1])
        for j in range(1, PIVOTS + 1):
            if best[before][j - 1] is not None:
                cost = best[before][j - 1][0] + leads
                if now[j] is None or cost < now[j][0]:
                    now[j] = (cost, best[before][j - 1][1] + [i])
        best.append(now)
    return best[-1][PIVOTS][1]


def near_pairs(words: DataFrame) -> DataFrame:
    """``a`` and ``b`` with their counts ``an``, ``bn``: each pair of words one edit apart, ``a`` before ``b``.

    ``words`` is a stored table.
    """
    grams = words.select("word", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.length("word") - 2), lambda i: F.substr("word", i + 1, F.lit(2)))).alias("place", "gram"))
    # the letters' alphabet bounds this table: 58 + 64 letters, so fewer than 15,000 bigrams
    order = grams.groupBy("gram").agg(F.count("*").alias("words"))
    rank = {r["gram"]: (i, r["words"]) for i, r in enumerate(order.orderBy("words", "gram").collect())}
    shared = words.sparkSession.sparkContext.broadcast(rank)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = shared.value
        for batch in batches:
            for part in pieces(batch, "word", 1 << 18):
                place, gram, row, pivot = [], [], [], []
                for i, word in enumerate(part.column("word").to_pylist()):
                    every = sorted((ranks[word[p:p + 2]], p) for p in range(len(word) - 1))
                    last = every[PREFIX - 1][0]
                    prefix = sorted((p, r) for r, p in every if r <= last)
                    chosen = set(pivots_of([(p, r[1]) for p, r in prefix]))
                    for k, (p, (r, _)) in enumerate(prefix):
                        place.append(p)
                        gram.append(r)
                        row.append(i)
                        pivot.append(k in chosen)
                columns = [part.column(c).take(pa.array(row, pa.int32())) for c in ("word", "n", "size", "odd")]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(place, pa.int32()), pa.array(gram, pa.int32()), pa.array(pivot, pa.bool_())],
                    names=["word", "n", "size", "odd", "place", "gram", "pivot"])

    cut_words = materialise(words.select("word", "n", F.length("word").alias("size"), odd_letters().alias("odd")).mapInArrow(
        cut, "word string, n long, size int, odd long, place int, gram int, pivot boolean"), "prefixes")
    prefix = cut_words.select("gram", "place", "size", F.col("word").alias("b"), F.col("n").alias("bn"), F.col("odd").alias("bo"))
    # where the bigram may lie in the other word, by how much longer that one is
    moves = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.lit(m).alias("m"))
                                for d, m in ((0, 0), (1, 0), (1, 1), (-1, 0), (-1, -1))])).alias("_v")
    pivot = cut_words.where("pivot").select("*", moves).select(
        "gram", (F.col("place") + F.col("_v.m")).alias("place"), (F.col("size") + F.col("_v.d")).alias("size"),
        F.col("_v.d").alias("d"), F.col("word").alias("a"), F.col("n").alias("an"), F.col("odd").alias("ao"))
    changed = F.bit_count(F.col("ao").bitwiseXOR(F.col("bo")))
    likely = F.when(F.col("d") == 0, changed <= 2).otherwise(changed == 1)
    found = pivot.join(prefix, ["gram", "place", "size"]).where(likely & (F.levenshtein("a", "b", 1) == 1))
    first = F.col("a") < F.col("b")
    swap = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    return found.select(swap("a", "b").alias("a"), swap("an", "bn").alias("an"),
                        swap("b", "a").alias("b"), swap("bn", "an").alias("bn")).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root`` of the words that have a ``form``: the last word on the way from form to form.

    A form is ``TIMES`` as frequent, so ways are short and have no circles.
    """
    way = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = way.select(F.col("word").alias("root"), F.col("root").alias("_on"))
        far = materialise(way.join(on, "root", "left").select(
            "word", F.coalesce("_on", "root").alias("root"), F.col("_on").isNotNull().alias("_moved")), "roots")
        way = far.select("word", "root")
        if far.where("_moved").isEmpty():
            return way


def grouped(docs: DataFrame) -> DataFrame:
    words = materialise(vocabulary(docs), "vocabulary")
    pairs = materialise(near_pairs(words), "near")
    both = pairs.select(F.col("a").alias("word"), F.col("an").alias("n"), F.col("b").alias("near"), F.col("bn").alias("near_n")) \
        .unionByName(pairs.select(F.col("b").alias("word"), F.col("bn").alias("n"), F.col("a").alias("near"), F.col("an").alias("near_n")))
    best = both.groupBy("word", "n").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("_best"))
    enough = -F.col("_best.less") >= TIMES * F.col("n")
    near = materialise(best.select("word", "n_near", F.when(enough, F.col("_best.near")).alias("form"),
                                   F.when(enough, -F.col("_best.less")).alias("form_n")), "forms")
    last = roots(near.where("form is not null"))
    return words.join(near, "word", "left").join(broadcast_if_small(last), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(table(spark, sf_dir, "documents"))


QUERIES = [op13_spelling_variants]
ORACLES: dict[str, str] = {}
