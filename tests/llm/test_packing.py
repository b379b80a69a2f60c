import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from cohortlens.llm import packing as P

TOKENIZER = Tokenizer.from_file(P.TOKENIZER)


def ids(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [0]


def check(frame, texts, capacity):
    """Every piece is right, and sequences are full without gaps or overlaps."""
    for doc, mine in frame.groupby("doc_id"):
        mine = mine.sort_values(["piece", "sequence_id"])
        want = np.array(ids(texts[doc]), "<u4")
        lengths = [len(want)] if len(want) <= capacity else (
            ([len(want) % capacity] if len(want) % capacity else []) + [capacity] * (len(want) // capacity))
        start = np.cumsum([0] + lengths[:-1])
        got = mine.drop_duplicates("piece")
        assert list(got.length) == lengths and list(got.start) == list(start)
        assert list(got.ids_crc32) == [zlib.crc32(want[a:a + n].tobytes()) for a, n in zip(start, lengths)]
    for _, seq in frame.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert list(seq.offset) == list(np.cumsum([0] + list(seq.length)[:-1]))
        assert seq.length.sum() <= capacity


def test_pieces_and_places(documents):
    rows = [(1, None), (2, ""), (3, "plain words, 12 of them.\n\n  it's <|endoftext|> here"), (4, "héé ²³ ½  x \x1c y 漢字 🙂"),
            (5, "word " * 90), (6, "same"), (7, "same"), (7, "same"), (8, "a_b__c  d\t\te' 'll _x 9_9")]
    frame = P.pack(documents(rows), capacity=32).toPandas()
    check(frame, dict(rows), 32)
    assert len(frame[frame.doc_id == 7]) == 2
    assert len(frame[frame.length == 32]) == len(ids("word " * 90)) // 32


def test_empty_table(documents):
    assert P.pack(documents([])).count() == 0


def test_usual_texts_have_the_tokenizers_ids():
    fast = P.token_ids()
    for text in ["", " ", "a  b", "x\n\n\ny ", "don't we'll I'VE", "Ünïcode Straße – “q” …", "_a __ 1_2", "\t \t!", "a×b÷"]:
        assert np.frombuffer(fast.text(text), "<u4").tolist() == ids(text)[:-1]


@pytest.mark.parametrize("seed", range(3))
def test_plan_uses_every_piece_once(seed):
    r = np.random.default_rng(seed)
    counts = np.bincount(r.integers(1, 257, 4000) if seed else np.full(500, 86), minlength=257)
    planned = P.plan(counts)
    used = np.zeros(257, int)
    for lengths, m in planned:
        assert sum(lengths) <= 256 and m > 0
        for x in lengths:
            used[x] += m
    assert (used == counts).all()
    total = (counts * np.arange(257)).sum()
    if seed:
        assert sum(m for _, m in planned) <= 1.02 * -(-total // 256)


def test_multiplicative_updates_lower_the_error():
    counts = np.zeros(11, int)
    counts[[3, 7, 5]] = [100, 80, 40]
    patterns = P.fill_patterns(counts)
    x = P.repeat_counts(patterns, counts)
    made = np.bincount(patterns.ravel(), ((patterns > 0) * x[:, None]).ravel(), 11)
    # 7 and 3 share a pattern: the best repeats lie between their counts
    assert (x >= 0).all() and abs(made[7] - 90) < 1 and abs(made[5] - 40) < 1
