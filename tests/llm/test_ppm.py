import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from cohortlens.llm import ppm as P
from cohortlens.storage import materialise


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def run(documents, rows):
    docs = documents(rows)
    return P.scored(docs, materialise(P.training_counts(docs), "counts")).toPandas()


def base_by_hand(rows):
    counts = Counter()
    for i, t in rows:
        if not held(i):
            counts.update((t or "").encode().lower().split() + [b""])
    n, v = sum(counts.values()), len(counts)
    return n, {(i, t): (len(w), sum(counts[x] > 0 for x in w), sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w))
               for i, t in rows for w in [(t or "").encode().lower().split() + [b""]]}


def ppm_by_hand(rows):
    """A function to the log10 probability of a text: the textbook recursion over nested dictionaries."""
    follow = defaultdict(Counter)
    total = 0
    for i, t in rows:
        if not held(i):
            raw = bytes(P.ORDER) + (t or "").encode() + bytes([P.END])
            total += len(raw) - P.ORDER
            for at in range(P.ORDER, len(raw)):
                for k in range(P.ORDER + 1):
                    follow[raw[at - k:at]][raw[at]] += 1
    known = {c for c, f in follow.items() if len(c) <= 2 or sum(f.values()) << P.CONTEXT_BITS >= total}

    def score(text):
        raw, out = bytes(P.ORDER) + (text or "").encode() + bytes([P.END]), 0.0
        for at in range(P.ORDER, len(raw)):
            excluded = set()
            for k in range(P.ORDER, -1, -1):
                context = raw[at - k:at]
                if context not in known:
                    continue
                seen = {s: n for s, n in follow[context].items() if s not in excluded}
                if not seen:
                    continue
                whole = sum(seen.values()) + len(seen)
                if raw[at] in seen:
                    out += math.log10(seen[raw[at]] / whole)
                    break
                out += math.log10(len(seen) / whole)
                excluded |= set(follow[context])
            else:
                out -= math.log10(P.SYMBOLS - len(excluded))
        return out
    return score


ROWS = [(i, t) for i, t in enumerate([
    "the cat sat on the mat", "The CAT and the dog", "a rat sat", None, "", "\n\t ", "überall  käse\x0bbrot", "the the the the",
    "zzz qqq 0123", "cat\x1cdog cat", "mat mat", "the cat sat on the mat", "X" * 3000, "on and on", "dog cat rat 漢字"])]


@pytest.mark.parametrize("bits", [18, 6])
def test_both_models_by_hand(documents, monkeypatch, bits):
    monkeypatch.setattr(P, "CONTEXT_BITS", bits)
    monkeypatch.setattr(P, "WORD_BITS", 3)  # most words take the join
    rows = ROWS + [(None, "the cat"), (3, "twice"), (3, "twice")]
    out = run(documents, rows)
    tokens, base = base_by_hand(rows)
    score = ppm_by_hand(rows)
    assert len(out) == len(rows) and (out.train_tokens == tokens).all()
    for i in range(15):
        for r in out[out.doc_id == i].itertuples():
            texts = [t for j, t in rows if j == i]
            assert r.held_out == held(i)
            assert any((r.n_tokens, r.n_known) == base[i, t][:2] and r.base_score == pytest.approx(base[i, t][2])
                       and r.score == pytest.approx(score(t), rel=1e-5) for t in texts)


@pytest.mark.parametrize("bits", [22, 3])
def test_rare_contexts_are_known_in_a_large_corpus(documents, monkeypatch, bits):
    monkeypatch.setattr(P, "KEY_BITS", bits)  # with 3 most keys take the join
    filler = [(100 + i, "z" * 60_000) for i in range(20)]
    rows = [(0, "qwertyu"), (1, "qwertyu"), (3, "awexrtk"), (4, "awexrtk")]
    out = run(documents, rows + filler)
    monkeypatch.setattr(P, "CONTEXT_BITS", 62, raising=False)  # by hand: every context is known
    score = ppm_by_hand(rows + filler)
    assert P.ORDER >= 6
    for r in out[out.doc_id < 2].itertuples():
        assert r.score == pytest.approx(score("qwertyu"), rel=1e-5)


def test_empty_table_and_no_training_rows(documents):
    assert len(run(documents, [])) == 0
    only = next(i for i in range(100) if held(i))
    out = run(documents, [(only, "ab c")])
    assert out.n_known[0] == 0 and out.train_tokens[0] == 0 and out.base_score[0] == pytest.approx(0)
    assert out.score[0] == pytest.approx(-5 * math.log10(256))


def test_probabilities_of_the_next_byte_sum_to_one_at_most():
    keys, _ = P.byte_keys([b"abracadabra", b"banana band", b"cab"])
    k, key, n = [], [], []
    for order in range(P.ORDER + 1):
        u, c = np.unique(keys & np.uint64((1 << 8 * (order + 1)) - 1), return_counts=True)
        k += [order] * len(u)
        key += u.tolist()
        n += c.tolist()
    trie = P.Trie(np.array(k), np.array(key, np.int64), np.array(n))
    for context in (b"\0\0\0\0\0", b"abrac", b"zzzzz", b"anana", b"zzzza"):
        front = np.uint64(int.from_bytes(context, "big") << 8)
        total = (10 ** trie.costs(np.arange(256, dtype=np.uint64) | front)).sum()
        assert 0.5 < total <= 1 + 1e-6


def test_blocks_give_back_grams_counts_and_keep_a_group_together():
    rng = np.random.default_rng(5)
    common = np.uint64(int.from_bytes(b" th", "big")) << np.uint64(8)  # a third of the grams end alike
    keys = np.concatenate([rng.integers(0, 1 << 56, 2000, np.uint64),
                           rng.integers(0, 1 << 24, 1000, np.uint64) << np.uint64(32) | common | np.uint64(101)])
    assert (P.turned(P.turned(keys)) == keys).all()
    grams = np.unique(P.turned(keys))
    n = np.stack([rng.integers(0, 5, len(grams)), rng.integers(5, 1 << 40, len(grams))], axis=1)
    *blocks, order = P.packed(grams, n, 64)
    assert len(order) == len(grams)
    got = {}
    for group, size, block in zip(*blocks):
        own, times = P.unpacked(size, block, 2)
        assert (np.diff(own.astype(np.int64)) > 0).all()
        for g, t in zip(own.tolist(), times.tolist()):
            assert g not in got
            got[g] = (group, t)
    assert {g: t for g, (_, t) in got.items()} == dict(zip(grams.tolist(), n.tolist()))
    by_end = {}
    for g, (group, _) in got.items():
        assert by_end.setdefault(g >> 32, group) == group


def test_counts_handed_on_in_many_parts_are_the_same(documents, monkeypatch):
    whole = run(documents, ROWS).sort_values("doc_id").reset_index(drop=True)
    monkeypatch.setattr(P, "HELD", 3)
    monkeypatch.setattr(P, "PIECE", 20)
    monkeypatch.setattr(P, "SCORED", 20)
    monkeypatch.setattr(P, "KEY_BITS", 4)
    monkeypatch.setattr(P, "GROUP_POSITIONS", 1000)
    parts = run(documents, ROWS).sort_values("doc_id").reset_index(drop=True)
    assert parts.score.to_numpy() == pytest.approx(whole.score.to_numpy(), rel=1e-6)
    assert (parts.n_known == whole.n_known).all()


def test_a_piece_brings_the_grams_of_all_its_texts_in_one_block():
    places, times = np.array([0, 2, 1, 2], np.uint32), np.array([1, 3, 2, 1], np.uint32)
    block = P.squeezed(np.stack([np.diff(places, prepend=np.uint32(0)), times]))
    piece = pa.table({"piece": [70], "n_grams": [[2, 0, 2]], "grams": pa.array([block], pa.binary())})
    found = pa.table({"start": [2, 0], "costs": pa.array([np.array(c, np.float32).tobytes() for c in ([-4.0], [-1.0, -2.0])], pa.binary())})
    assert P.added(None, piece, found).to_pylist() == [{"row": 70, "_score": -13.0}, {"row": 72, "_score": -8.0}]


def test_distinct_numbers_and_their_places():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 1 << 56, 500, np.uint64)[rng.integers(0, 500, 5000)]
    alike = np.array([7, 7, 6, 9, 8, 7, 1 << 40], np.uint64)  # the first bits are the same: the usual way is taken
    for spread in (P.mixed(keys), alike, alike[:1], alike[:0]):
        each, back = P.distinct(spread)
        assert each.tolist() == np.unique(spread).tolist() and (each[back] == spread).all()
    assert (P.unmixed(P.mixed(keys)) == keys).all()
