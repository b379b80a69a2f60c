"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text stands for each language. A text is parsed
against it from left to right into phrases, each the longest match that begins
there; a byte that the language's text lacks is a phrase of its own. A phrase
costs the logarithm of the length of the language's text, as a pointer into it
would, and the language with the least cost wins: the one that needs the
fewest phrases, normalised for the amount of text it was learned from.

The automata are built from a bounded sample: ``MODEL_BYTES`` of lower-cased
text a language, in blocks of ``BLOCK`` bytes. Every block of every labelled
training document has the same chance; those with the smallest hashes are
taken. With so many languages that this exceeds ``TOTAL_BYTES``, each gets an
equal share of that, one block at least. All texts are parsed whole.

A parse forgets everything where a phrase begins. So a text is cut into
segments that are parsed side by side, each from its own beginning; the parse
of one segment then runs on into the next ones until it begins a phrase where
they began one too, and from there on both are the same.

Defined cases: a null text and one without a letter are ``und`` with score 0,
and so is every text if there is nothing to learn from. Rows without ``lang``
or ``doc_id`` are not learned from. A tie goes to the smaller name. Repeated
rows are predicted each. A very long text costs time in proportion to its
length. ``score`` is the best language's share when the costs of all languages
are read as code lengths. Other columns of the input are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.llm.lines import text_bytes
from cohortlens.llm.shingles import mixed
from cohortlens.llm.tables import pieces, table

FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
#: Text that a language is learned from, that of all languages together, and a block of it, in bytes.
MODEL_BYTES, TOTAL_BYTES, BLOCK = 1 << 16, 1 << 21, 1 << 10
#: Bytes of a text that one lane parses.
SEGMENT = 512
#: So many lanes and fewer are followed one by one.
FEW_LANES = 200
#: Bytes of text that a task works on at once.
PIECE = 4 << 20
#: No text holds it: it keeps matches inside one block.
BREAK = 0
LOW = (1 << 32) - 1
#: ASCII letters and bytes of other characters count as they are, anything else as a space.
LETTERS = np.array([b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


class Automaton(NamedTuple):
    """Transitions in one table. A state is a number ``s``, its place in the table: by ``c`` it goes to the low half
    of ``table[s + c]`` if the high half there is ``s``.

    State 0 begins a phrase. Its own transitions are in ``root``, and the table has none for it.
    """
    table: np.ndarray
    root: np.ndarray
    learned: int


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """The transitions of each state of the smallest automaton that knows all substrings."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        now = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = now
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                link[q] = link[now] = twin
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
        last = now
    return step


def packed(step: list[dict[int, int]], learned: int) -> Automaton:
    """Lay the states' transitions over each other where they leave room, the fullest states first."""
    width = 256
    for edges in step:
        edges.pop(BREAK, None)
    base = np.zeros(len(step), np.int64)
    size = 2 * sum(map(len, step)) + len(step) + 8 * width
    free, unused = np.ones(size, bool), np.ones(size, bool)
    unused[0] = False
    several = sorted((s for s in range(1, len(step)) if len(step[s]) > 1), key=lambda s: -len(step[s]))
    low = 1
    for s in several:
        edges, at = np.fromiter(step[s], np.int64), low
        while True:
            fits = unused[at:min(at + 1024, size - width)].copy()
            for c in edges.tolist():
                fits &= free[at + c:at + c + len(fits)]
            found = int(fits.argmax())
            if fits[found]:
                break
            at += len(fits)
        base[s] = at + found
        unused[base[s]] = False
        free[base[s] + edges] = False
        low = max(low, int(base[s]) - 2 * width)
    # states with one transition fill what is left, each with a place of its own
    left = np.array([s for s in range(1, len(step)) if len(step[s]) == 1], np.int64)
    symbols = np.array([next(iter(step[s])) for s in left.tolist()], np.int64)
    turn = 0
    while len(left):
        room = np.flatnonzero(free[width:]) + width
        cells = room[turn * 7919 % (len(room) - len(left) + 1):][:len(left)]
        place = cells - symbols
        mine = np.zeros(len(cells), bool)
        mine[np.unique(place, return_index=True)[1]] = True
        mine &= unused[place]
        base[left[mine]] = place[mine]
        unused[place[mine]] = free[cells[mine]] = False
        left, symbols, turn = left[~mine], symbols[~mine], turn + 1
    ends = [s for s in range(1, len(step)) if not step[s]]
    base[ends] = np.flatnonzero(unused)[:len(ends)]
    at = base.tolist()
    places = [(at[s] + c, at[s] << 32 | at[t]) for s in range(1, len(step)) for c, t in step[s].items()]
    table = np.full(int(base.max(initial=0)) + width, -1, np.int64)
    if places:
        where, what = np.array(places, np.int64).T
        table[where] = what
    root = np.zeros(width, np.int64)
    for c, s in step[0].items():
        root[c] = at[s]
    return Automaton(table, root, learned)


def build(blocks: list[bytes]) -> Automaton:
    symbols: list[int] = []
    for block in blocks:
        symbols += LETTERS[np.frombuffer(block, np.uint8)].tolist() + [BREAK]
    return packed(suffix_automaton(symbols), len(symbols))


def phrases(model: Automaton, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Phrases of each text; text ``i`` is ``symbols[at[i]:at[i + 1]]``."""
    table, root = model.table, model.root
    count = -(-np.diff(at) // SEGMENT)
    document = np.repeat(np.arange(len(count)), count)
    first = np.cumsum(count) - count
    begin = at[document] + SEGMENT * (np.arange(len(document)) - first[document])
    stop = at[document + 1]
    end = np.minimum(begin + SEGMENT, stop)
    order = np.argsort(begin - end, kind="stable")  # the longest segments first
    inside = np.arange(SEGMENT) < (end - begin)[:, None]
    grid = np.full(inside.shape, BREAK, np.uint8)
    grid[inside] = symbols
    columns = np.ascontiguousarray(grid[order].T)
    fresh = np.zeros(columns.shape, bool)
    more = len(order) - np.searchsorted(np.sort(end - begin), np.arange(SEGMENT), side="right")
    state = np.zeros(len(order), np.int64)
    for i in range(SEGMENT):
        k = more[i]
        if not k:
            break
        c, s = columns[i, :k], state[:k]
        edge = table[s + c]
        new = np.not_equal(edge >> 32, s, out=fresh[i, :k])
        state[:k] = np.where(new, root[c], edge & LOW)
    last = np.empty_like(state)
    last[order] = state
    rows = np.empty_like(inside)
    rows[order] = fresh.T
    begins = rows[inside]
    before = np.zeros(len(symbols) + 1, np.int64)
    np.cumsum(begins, out=before[1:])

    # each segment's parse goes on until it meets that of a later one
    lanes = np.flatnonzero(end < stop)
    extra, meet = np.zeros(len(begin), np.int64), np.full(len(begin), -1)
    here, s, until = end[lanes], last[lanes], stop[lanes]
    while len(lanes) > FEW_LANES:
        c = symbols[here]
        edge = table[s + c]
        new = edge >> 32 != s
        met = new & begins[here]
        meet[lanes[met]] = here[met]
        extra[lanes] += new & ~met
        s, here = np.where(new, root[c], edge & LOW), here + 1
        open_ = ~met & (here < until)
        lanes, here, s, until = lanes[open_], here[open_], s[open_], until[open_]
    edges, starts, text, fresh_at = memoryview(table), root.tolist(), memoryview(symbols), memoryview(begins)
    for lane, i, one, limit in zip(*(x.tolist() for x in (lanes, here, s, until))):
        count_more = 0
        while i < limit:
            value = edges[one + text[i]]
            if value >> 32 == one:
                one = value & LOW
            elif fresh_at[i]:
                meet[lane] = i
                break
            else:
                count_more += 1
                one = starts[text[i]]
            i += 1
        extra[lane] += count_more

    met = meet >= 0
    own = np.append(before[end] + extra - np.where(met, before[np.maximum(meet, 0)], 0), 0)
    then = np.full(len(begin) + 1, len(begin))
    then[:-1][met] = np.searchsorted(begin, meet[met], side="right") - 1
    while (then < len(begin)).any():  # the way from segment to segment, twice as far each time
        own, then = own + own[then], then[then]
    out = np.zeros(len(count), np.int64)
    some = count > 0
    out[some] = own[first[some]] - before[begin[first[some]]]
    return out


def is_held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def lowered() -> Column:
    return F.lower("text").cast("binary").alias("text")


def labelled_blocks(docs: DataFrame) -> dict[str, list[bytes]]:
    """The sample that each language is learned from, at most ``TOTAL_BYTES`` or one block a language."""
    own = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out()
                     & (F.octet_length("text") > 0)).select(F.col("lang").cast("string").alias("lang"), "doc_id", lowered())
    there = {r["lang"]: r["n"] for r in own.groupBy("lang").agg(
        F.sum(F.ceil(F.octet_length("text") / BLOCK)).alias("n")).collect()}  # one row a language
    if not there:
        return {}
    wanted = max(1, min(MODEL_BYTES, TOTAL_BYTES // len(there)) // BLOCK)
    # twice as many as wanted lie below the limit, so that too few are out of question
    limits = {lang: min(1.0, (2 * wanted + 20) / n) for lang, n in there.items()}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for lang, doc, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "doc_id", "text"))):
                n = -(-len(text) // BLOCK)
                seed = np.uint64(zlib.crc32(text, zlib.crc32(str(doc).encode())))
                key = mixed(mixed(np.arange(n, dtype=np.uint64) + (seed << np.uint64(32)))) >> np.uint64(1)
                for i in np.flatnonzero(key < limits[lang] * 2.0 ** 63).tolist():
                    out.append((lang, int(key[i]), text[i * BLOCK:(i + 1) * BLOCK]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.int64()),
                 pa.array([r[2] for r in out], pa.binary())], names=["lang", "key", "block"])

    picked = own.mapInArrow(cut, "lang string, key long, block binary").distinct()
    ranked = picked.withColumn("_at", F.row_number().over(Window.partitionBy("lang").orderBy("key", "block")))
    found: dict[str, list[bytes]] = {}
    for row in ranked.where(F.col("_at") <= wanted).orderBy("lang", "_at").collect():
        found.setdefault(row["lang"], []).append(bytes(row["block"]))
    return found


def train(docs: DataFrame) -> dict[str, Automaton]:
    return {lang: build(blocks) for lang, blocks in labelled_blocks(docs).items()}


def predicted(docs: DataFrame, models: dict[str, Automaton]) -> DataFrame:
    """``doc_id``, ``held_out``, the language, its score, and the phrases it needed."""
    names = sorted(models)
    shared = docs.sparkSession.sparkContext.broadcast([models[m] for m in names])  # TOTAL_BYTES bound its size

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", PIECE):
                raw, at = text_bytes(part.column("text"))
                symbols, n = LETTERS[raw], part.num_rows
                known = np.array(part.column("letters").to_pylist(), bool)
                lang, score, best = np.full(n, UNKNOWN, object), np.zeros(n), np.full(n, None, object)
                if names and n:
                    every = np.stack([phrases(m, symbols, at) for m in shared.value])
                    cost = every * np.array([[math.log(m.learned + 1)] for m in shared.value])
                    pick = cost.argmin(axis=0)
                    least = cost[pick, np.arange(n)]
                    lang[known] = np.array(names, object)[pick[known]]
                    score[known] = (1 / np.exp(least - cost).sum(axis=0))[known]
                    best[known] = every[pick, np.arange(n)][known]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(lang.tolist(), pa.string()), pa.array(score),
                     pa.array(best.tolist(), pa.int64())], names=["doc_id", "held_out", "lang_pred", "score", "n_phrases"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out().alias("held_out"), lowered(),
                      F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return own.mapInArrow(parse, "doc_id long, held_out boolean, lang_pred string, score double, n_phrases long")


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predicted(docs, train(docs))


QUERIES = [op11_language_id]
ORACLES: dict[str, str] = {}
