"""Toxicity: restore disguised words, then score the restored text.

A noisy channel writes letters as look-alike signs, repeats them, puts marks
between them or spaces them out. A word that may have passed it becomes a
lattice of letters; the cheapest path under a character trigram model, counted
over all documents, is the restored word (Viterbi). Words and beginnings of
words that mark toxic documents are learned from labelled documents: forms that
toxic documents hold far more often than chance allows, near copies counted
once, and forms needed for toxic documents that no earlier one covers. A
document's score is the probability that at least one of its marks is right
(noisy or).

Defined cases: a null text counts as empty; a document without marks has the
rate of toxic documents among such ones as its score. Rows with a null
``doc_id`` are scored and never fitted. A ``doc_id`` with several labels takes
the smallest. Without labelled rows every score is 0. Repeated rows are scored
each; other columns of the input are not read.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.quality import fit_rows, fold_of
from cohortlens.llm.tables import table
from cohortlens.storage import materialise

#: Labelled documents that the model is fitted to at most, those with the smallest hashes.
FIT_ROWS = 8000
THRESHOLD = 0.5
FOLDS, HELD_OUT = 5, 0
#: Lengths of the beginnings of words that may be marks.
BEGINNINGS = range(3, 9)
#: A mark covers this many toxic documents at least, and a clean one costs it as many as that.
LEAST, COST = 3, 3
#: Distinct words that a worker remembers.
REMEMBERED = 1_000_000

# Signs that stand for letters.
SIGNS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t",
         "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e"}
MARKS = set("._-~^'`,:;/\\")
WILD = "*#"
LETTERS = "abcdefghijklmnopqrstuvwxyz"

SIGN_COST, WILD_COST, MARK_COST, JOIN_COST, BREAK_COST = 1.0, 3.0, 0.5, 0.1, 2.0
#: A repeated letter is dropped cheaply or dearly; both readings are looked at.
REPEAT_COSTS = (0.3, 6.0)
#: A beginning needs as many different words, and a mark this share of toxic documents.
KINDS, SURE = 4, 0.65
DISGUISED = re.compile(r"(.)\1\1|[^\W\d_].*[\W\d_].*[^\W\d_]|^[\d@$!|+(€]+[^\W\d_]|[^\W\d_][\d@$!|+(€]+$")
SPACED = re.compile(r"(?<!\S)\S(?:[ \t]{1,3}\S){2,}(?!\S)")
EDGES = re.compile(r"^[\W_]+|[\W_]+$")
SIGNS_AT_EDGE = re.compile(r"^[^\w@$!|+(€]+|[^\w@$|+€]+$|([$@|+€])\1{2,}$")
TRIPLE = re.compile(r"(.)\1\1")
#: Signs around a word that stand for no letter, and those that may.
COMMON_EDGES = ".,;:!?\"'`()[]{}<>&%#*-_~|$"
SIGNED_EDGE = re.compile(r"^[@$!|+(€]|(?<![@$|+€])[@$|+€]{1,2}$")
LETTER = re.compile(r"[^\W\d_]")


class Letters:
    """Character trigrams of words, with a share for what was not seen."""

    def __init__(self, counts: dict[str, int]):
        self.counts = counts
        self.pairs: dict[str, int] = defaultdict(int)
        for gram, n in counts.items():
            self.pairs[gram[:2]] += n
        self.kinds = len({g[2] for g in counts}) + 1

    def cost(self, pair: str, letter: str) -> float:
        seen = self.counts.get(pair + letter, 0)
        return -math.log((seen + 0.02) / (self.pairs.get(pair, 0) + 0.02 * self.kinds))


def trigrams(words: Iterable[str]) -> Counter:
    """Trigrams of words of letters, with ``^^`` before and ``$`` after."""
    out: Counter = Counter()
    for word in words:
        padded = f"^^{word}$"
        out.update(padded[i:i + 3] for i in range(len(padded) - 2))
    return out


def restore(seen: str, letters: Letters, repeat_cost: float = REPEAT_COSTS[0]) -> list[str]:
    """The cheapest words behind ``seen``; a space in it may be a gap in a word or between two."""
    best = {("^^", ""): (0.0, "")}
    for sign in seen:
        found: dict[tuple[str, str], tuple[float, str]] = {}

        def offer(key, cost, text):
            old = found.get(key)
            if old is None or (cost, text) < old:
                found[key] = (cost, text)

        if sign.isspace():
            for (pair, last), (cost, text) in best.items():
                offer((pair, last), cost + JOIN_COST, text)
                if pair != "^^":
                    offer(("^^", ""), cost + BREAK_COST + letters.cost(pair, "$"), text + " ")
        else:
            choices = [(sign, 0.0)] if sign.isalpha() else []
            choices += [(x, SIGN_COST) for x in SIGNS.get(sign, "")]
            if sign in WILD:
                choices += [(x, WILD_COST) for x in LETTERS]
            if not choices and sign not in MARKS:
                choices = [(sign, 0.0)]
            for (pair, last), (cost, text) in best.items():
                if sign in MARKS or sign in WILD:
                    offer((pair, last), cost + MARK_COST, text)
                for letter, extra in choices:
                    offer((pair[1] + letter, letter), cost + extra + letters.cost(pair, letter), text + letter)
                    if letter == last:
                        offer((pair, last), cost + extra + repeat_cost, text)
        best = found
    ends = [(cost + letters.cost(pair, "$"), text) for (pair, _), (cost, text) in best.items()]
    return min(ends)[1].split() if ends else []


def readings(seen: str, letters: Letters) -> list[str]:
    return sorted({w for cost in REPEAT_COSTS for w in restore(seen, letters, cost)})


def plain(word: str) -> str:
    return EDGES.sub("", word)


def words_of(word: str, letters: Letters | None) -> list[str]:
    """What a lower-case word without white space may stand for: itself, and what it restores to."""
    bare = plain(word)
    out = [bare] if bare else []
    core = SIGNS_AT_EDGE.sub("", word)
    if letters is not None and (not core.isalpha() or TRIPLE.search(core)) \
            and DISGUISED.search(core) and LETTER.search(core):
        out += readings(core, letters)
        if core != bare and DISGUISED.search(bare):
            out += readings(bare, letters)
    return out


def spaced_words(text: str, letters: Letters | None) -> list[str]:
    """Words restored from runs of single characters between spaces."""
    if letters is None:
        return []
    runs = {" ".join(m.split()) for m in SPACED.findall(text)}
    # a one-letter word of the sentence may stand before or after the spaced one
    runs |= {part for run in runs for part in (run[2:], run[:-2])}
    return [w for run in runs if len(set(run)) > 2 for w in readings(run, letters)]


def restored_words(text: str, letters: Letters | None) -> set[str]:
    text = text.lower()
    out = {w for word in set(text.split()) for w in words_of(word, letters)}
    return out | set(spaced_words(text, letters))


def forms(word: str) -> list[str]:
    """A word, and its beginnings marked by a trailing ``-``."""
    return [word] + [word[:n] + "-" for n in BEGINNINGS if len(word) > n]


def cover(hits: dict[str, tuple[set, set]], toxic: set) -> dict[str, tuple[int, int]]:
    """Marks in the order in which each gains most: toxic documents not covered yet, less clean ones.

    ``hits``: from a form to its toxic and its clean documents. Equal gains go to the whole word,
    then to the longer beginning.
    """
    chosen: dict[str, tuple[int, int]] = {}
    bare, flagged = set(toxic), set()
    open_forms = dict(hits)
    while open_forms:
        def gain(form: str) -> int:
            bad, good = open_forms[form]
            return len(bad & bare) - COST * len(good - flagged)

        gains = {f: gain(f) for f in open_forms}
        form = max(gains, key=lambda f: (gains[f], not f.endswith("-"), len(f), f))
        if gains[form] < LEAST:
            break
        bad, good = open_forms.pop(form)
        chosen[form] = (len(bad), len(good))
        bare -= bad
        flagged |= good
        open_forms = {f: h for f, h in open_forms.items() if gains[f] >= LEAST}
    return chosen


def significant(near: list, n_bad: int, n_good: int) -> dict[str, tuple[int, int]]:
    """Forms that are likelier to mark toxic documents than any of all tested would be by chance.

    ``near``: form, its toxic and clean documents (near copies once), and words with that beginning.
    One of several beginnings with nearly the same documents stays, the longest.
    """
    rate = max(n_bad, 1) / max(n_bad + n_good, 2)
    bar = 2 * math.log(10 * len(near) + 10)
    out = {}
    for form, bad, good, kinds in near:
        share = bad / (bad + good)
        if form.endswith("-") and kinds < KINDS or (bad + 0.5) / (bad + good + 1) < SURE or share <= rate:
            continue
        surprise = bad * math.log(share / rate) + (good * math.log((1 - share) / (1 - rate)) if good else 0)
        if 2 * surprise >= bar:
            out[form] = (bad, good)
    longer = {f: b for f, (b, _) in out.items()}
    return {f: v for f, v in out.items() if not (f.endswith("-") and any(
        o.endswith("-") and o != f and o.startswith(f[:-1]) and n >= 0.95 * v[0] for o, n in longer.items()))}


class Model:
    """The trigram model, each mark's chance of a clean document, and the chance without marks."""

    def __init__(self, letters: Letters | None, marks: dict[str, float], rest: float):
        self.letters, self.marks, self.rest = letters, marks, rest
        self.name = uuid.uuid4().hex

    def found(self, words: Iterable[str]) -> set[str]:
        """The marks among words; of one word's forms only the surest."""
        out = set()
        for word in words:
            here = [f for f in forms(word) if f in self.marks]
            if here:
                out.add(min(here, key=self.marks.get))
        return out

    def score(self, marks: Iterable[str]) -> float:
        clean = 1 - self.rest
        for mark in sorted(marks):
            clean *= self.marks[mark]
        return min(max(1 - clean, 0.0), 1.0)


def trigram_counts(docs: DataFrame) -> dict[str, int]:
    """Trigrams of the Latin words of all texts; a task adds up its own, so only trigrams travel."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            words: Counter = Counter()
            for text in batch.column("text").to_pylist():
                words.update((text or "").lower().split())
            for seen, n in words.items():
                word = plain(seen)
                if word.isalpha() and max(map(ord, word)) < 592:  # Latin letters: at most 500 ** 3 trigrams
                    for gram, k in trigrams([word]).items():
                        total[gram] += k * n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())],
                                         names=["gram", "n"])

    texts = docs.select(F.col("text").cast("string").alias("text"))
    rows = texts.mapInArrow(count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return {r["gram"]: r["n"] for r in rows.collect()}


def with_kin(words: DataFrame) -> DataFrame:
    """Near copies of a text have nearly the same words, and so the same smallest hash of a word."""
    return words.withColumn("kin", F.array_min(F.transform("words", lambda w: F.xxhash64(w))))


def with_forms(words: DataFrame) -> DataFrame:
    """A row for each form of each word; ``kin`` is stored, as it would be worked out anew for every word otherwise."""
    begin = [F.when(F.length("word") > n, F.concat(F.substring("word", 1, n), F.lit("-"))) for n in BEGINNINGS]
    form = F.explode(F.array_compact(F.array(F.col("word"), *begin))).alias("form")
    return words.select("doc_id", "y", "kin", F.explode("words").alias("word")).select("doc_id", "y", "kin", "word", form)


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model | None:
    """Letters of all documents, marks of a bounded number of labelled ones; copies of a labelled text count once."""
    sample = materialise(fit_rows(docs, labels, "toxic", rows, FOLDS, HELD_OUT)
                         .dropDuplicates(["text", "_y"]).select("doc_id", "_y", "text"), "toxic-sample")
    if not sample.head(1):
        return None
    letters = Letters(trigram_counts(docs))

    def restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(restored_words(t or "", letters)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_y"),
                                              pa.array(found, pa.list_(pa.string()))], names=["doc_id", "y", "words"])

    words = materialise(with_kin(sample.mapInArrow(restored, "doc_id long, y int, words array<string>")), "toxic-words")
    shaped = with_forms(words)
    # bounded by the words of ``rows`` documents
    often = (shaped.where("y = 1").groupBy("form").agg(F.countDistinct("doc_id").alias("n"))
             .where(F.col("n") >= LEAST).select("form"))
    near = materialise(shaped.join(F.broadcast(often), "form"), "toxic-forms")
    tested = near.groupBy("form").agg(
        F.countDistinct(F.when(F.col("y") == 1, F.col("kin"))).alias("bad"),
        F.countDistinct(F.when(F.col("y") == 0, F.col("kin"))).alias("good"),
        F.countDistinct(F.when(F.col("y") == 1, F.col("word"))).alias("kinds"))
    tested = [tuple(r) for r in tested.collect()]
    wanted = [r[0] for r in tested if r[1] * (1 + COST) >= COST * (r[1] + r[2])
              and (r[3] >= KINDS or not r[0].endswith("-"))]
    hits: dict[str, tuple[set, set]] = defaultdict(lambda: (set(), set()))
    kept = docs.sparkSession.createDataFrame([(f,) for f in wanted], "form string")
    for r in near.join(F.broadcast(kept), "form").select("form", "doc_id", "y").distinct().collect():
        hits[r["form"]][1 - r["y"]].add(r["doc_id"])
    classes = {r["y"]: r for r in words.groupBy("y").agg(F.count("*").alias("n")).collect()}
    bad_ids = {r["doc_id"] for r in words.where("y = 1").select("doc_id").collect()}
    n_bad, n_good = (classes[y]["n"] if y in classes else 0 for y in (1, 0))
    chosen = cover(hits, bad_ids) | significant(tested, n_bad, n_good)
    marks = {f: (good + 0.5) / (bad + good + 1) for f, (bad, good) in chosen.items()}
    touched = [set().union(*(hits[f][side] for f in chosen if f in hits)) if chosen else set() for side in (0, 1)]
    rest = (n_bad - len(touched[0]) + 0.5) / (n_bad + n_good - len(touched[0]) - len(touched[1]) + 1)
    return Model(letters, marks, min(rest, 0.45))


class Reader:
    """Finds a model's marks in texts and remembers the words it has met."""

    def __init__(self, model: Model):
        self.model = model
        # every form of a word begins as the word does
        self.heads = {mark[:min(BEGINNINGS)] for mark in model.marks}
        self.known: set[str] = set()
        self.marked: dict[str, set[str]] = {}

    def meet(self, word: str) -> None:
        bare = word.strip(COMMON_EDGES)
        if bare.isalpha() and not TRIPLE.search(bare) and bare[:min(BEGINNINGS)] not in self.heads \
                and (bare == word or not SIGNED_EDGE.search(word)):
            return
        found = self.model.found(words_of(word, self.model.letters))
        if found:
            self.marked[word] = found

    def marks(self, text: str) -> set[str]:
        text = text.lower()
        every = text.split()
        words = set(every)
        if len(self.known) > REMEMBERED:
            self.known.clear()
            self.marked.clear()
        for word in words - self.known:
            self.meet(word)
        self.known |= words
        here = set().union(*(self.marked[w] for w in words & self.marked.keys()))
        if len(every) > 2:
            single = np.fromiter(map(len, every), np.int64, len(every)) == 1
            if (single[:-2] & single[1:-1] & single[2:]).any():
                here |= self.model.found(spaced_words(text, self.model.letters))
        return here


_READERS: dict[str, Reader] = {}


def reader(model: Model) -> Reader:
    """One per worker process and model: later tasks know the words of earlier ones."""
    if model.name not in _READERS:
        _READERS.clear()
        _READERS[model.name] = Reader(model)
    return _READERS[model.name]


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = reader(model)
        for batch in batches:
            marks = [sorted(known.marks(t or "")) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([model.score(m) for m in marks], pa.float64()),
                 pa.array(marks, pa.list_(pa.string()))], names=["doc_id", "score", "marks"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if model is None:
        return own.select("doc_id", F.lit(0.0).alias("score"), F.array().cast("array<string>").alias("marks"))
    return own.mapInArrow(score, "doc_id long, score double, marks array<string>")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    result = scored(docs, train(docs, table(spark, sf_dir, "labels")))
    return result.select(
        "doc_id", F.coalesce(fold_of("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "marks")


QUERIES = [op7_toxicity]
ORACLES: dict[str, str] = {}
