import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from cohortlens.llm import prefixtrie as P
from cohortlens.llm.tables import table

SCHEMA = "conv_id long, turn long, role string, text string, depth string, part string, n_convs int"


def by_hand(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in turns.items()}
    whole = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = own.get(c - c % 5, [])[:h] + v[h:]
    members, children = defaultdict(list), defaultdict(list)
    for c, v in whole.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved, out = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in children[p]) or 1
        own_bytes = len(p[-1][1].encode()) if p else 0
        saved[p] = (len(members[p]) - 1) * own_bytes + sum(saved[q] for q in children[p])
        ends = sorted(c for c in members[p] if len(whole[c]) == len(p))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children[p]), leaves[p],
                    saved[p], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def found(frame):
    return sorted((tuple(r) for r in frame.collect()), key=lambda r: r[:2])


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "d", "p", 1) for r in rows], SCHEMA)


@pytest.mark.parametrize("size", ["0.001", "0.01"])
def test_whole_table(spark, size):
    data = table(spark, f"/root/testdata/sf{size}", "conversations")
    rows = [tuple(r) for r in data.select("conv_id", "turn", "role", "text").collect()]
    assert found(P.trie(data)) == by_hand(rows)


@pytest.mark.parametrize("seed", range(2))
def test_many_shards_and_levels(spark, monkeypatch, seed):
    """Few different texts, so that much is shared; one conversation and its copy hold a third of the rows."""
    monkeypatch.setattr(P, "SHARD_ROWS", 5 + 20 * seed)
    monkeypatch.setattr(P, "TOP_SHARE", 10 ** 9)
    rng = random.Random(seed)
    rows = [(c, t, "ua"[t % 2], rng.choice("xyé")) for c in range(90) for t in range(rng.randint(1, 12))]
    rows += [(c, t, "u", str(t % 3)) for c in (200, 205) for t in range(150)]
    assert found(P.trie(conversations(spark, rows))) == by_hand(rows)


def test_cases(spark):
    rows = [(0, None, None, None), (0, 2, "user", "a" * 300_000), (0, 1, "", ""), (0, 1, "", ""), (None, 1, "user", "lost"),
            (1, 0, "user", "é"), (1, 0, "assistant", "é"), (7, 5, "user", "x"), (8, 5, "user", "x"), (9, 5, None, "x"), (9, None, "x", None)]
    rows += [(c, 0, "user", "same") for c in range(30, 60)]
    assert found(P.trie(conversations(spark, rows))) == by_hand(rows)
    assert found(P.trie(conversations(spark, []))) == []
    assert found(P.trie(conversations(spark, [(None, 1, "user", "x")]))) == []
    for c in (3, 9):  # a single conversation, perhaps without turns
        rows = [(c, 0, "user", "only")]
        assert found(P.trie(conversations(spark, rows))) == by_hand(rows)


def test_queue_spills_and_keeps_its_order():
    rng = random.Random(2)
    items = [(-rng.randint(0, 20), rng.randint(0, 30), i, 1) for i in range(5000)]
    queue = P.Queue(limit=100)
    for item in items:
        queue.push(item)
    assert len(queue.runs) > 10
    for key in sorted({i[:2] for i in items}):
        assert sorted(queue.pop_while(key)) == sorted(i for i in items if i[:2] == key)
    assert not queue.heap and not queue.runs
