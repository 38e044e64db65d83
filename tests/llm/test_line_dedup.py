"""Line dedup against a plain rewrite of the rule; the filter against a multiset."""

import collections

import numpy as np
import pytest

from panelry.llm import line_dedup
from panelry.llm.cuckoo import CuckooFilter
from panelry.llm.line_dedup import LineIndex

DOC = "doc_id long, text string, keys string, version int, text_md5 string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], DOC)


def expected(rows):
    """Lines kept, computed line by line."""
    def key(line):
        k = line.strip(" \t\n\x0b\x0c\r")
        k = "".join(c.lower() if "A" <= c <= "Z" else c for c in k)
        return k if len(k) >= 10 else None

    holders = collections.defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(line_dedup.LOWEST if i is None else i)
    out = []
    for i, text in rows:
        own, lines = line_dedup.LOWEST if i is None else i, (text or "").split("\n")
        stay = [x for x in lines if key(x) is None or len(holders[key(x)]) == 1 or min(holders[key(x)]) == own]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


def found(df):
    return sorted([(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in df.collect()], key=repr)


def corpus(seed, n, first=0):
    rng = np.random.default_rng(seed)
    lines = [f"Some line number {x}" for x in range(40)] + ["short", "", "  ", "éééééééééé", "ééééééééé", "same for all of them"]
    return [(first + i, "\n".join(rng.choice(lines, rng.integers(1, 9)))) for i in range(n)]


ODD = [
    (None, "Some line number 1\nof no id at all"), (None, "of no id at all"), (5000, None), (5001, ""), (5002, "\n\n"),
    (5003, " \tSOME LINE NUMBER 2\r\nsome line number 2\x0b"), (5003, "Some line number 3\nsecond row of an id"),
    (5004, "second row of an id\nSecond Row Of An Id"), (5005, "nbsp  Some line number 2"),
    (5006, "İstanbul line\nÀ LINE OF LETTERS"), (5007, "à line of letters\nİSTANBUL LINE"),
    (5008, "long " * 50000 + "\n" + "long " * 50000), (5009, "long " * 50000), (5009, "long " * 50000),
]


@pytest.mark.parametrize("increments", [1, 3])
def test_against_plain_rule(spark, increments):
    rows = corpus(1, 60) + ODD
    assert found(line_dedup.dedup_lines(frame(spark, rows), increments)) == expected(rows)


def test_deletion_restores_lines(spark):
    """An index after deletions keeps what an index of the remaining documents alone keeps."""
    rows, later = corpus(2, 50) + ODD, corpus(3, 20, first=100)
    index = LineIndex.empty(spark).insert(frame(spark, rows)).insert(frame(spark, later))
    gone = {0, 1, 2, 3, 4, 104, 5003, None}
    index = index.delete(frame(spark, [(i, None) for i in gone]))
    left = [r for r in rows + later if r[0] not in gone]
    assert found(index.kept(frame(spark, left))) == expected(left)
    # the filters know the lines still held, and inserting what went brings everything back
    keys = [r.key for r in index.current().collect()]
    known = {r.shard: CuckooFilter(line_dedup.BUCKETS, r.slots, r.stash) for r in index.filters.collect()}
    assert all(known[0].contains(bytes(k))[0] for k in keys) and len(known) == 1
    assert sum((f.slots != 0).sum() + len(f.stash) for f in known.values()) == len(keys)
    back = index.insert(frame(spark, [r for r in rows + later if r[0] in gone]))
    assert found(back.kept(frame(spark, rows + later))) == expected(rows + later)


def test_more_shards(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 8)
    rows, later = corpus(4, 40), corpus(5, 40, first=30) + [(900, "\n".join(f"a line of its own {i}" for i in range(50)))]
    index = LineIndex.empty(spark).insert(frame(spark, rows))
    wider = index.insert(frame(spark, later))
    assert 1 < index.shards < wider.shards
    assert found(wider.kept(frame(spark, rows + later))) == expected(rows + later)
    assert sum((np.frombuffer(r.slots, "<u2") != 0).sum() for r in wider.filters.collect()) == wider.current().count()


def test_hot_lines_by_broadcast_and_shuffle_agree(spark, monkeypatch):
    rows = corpus(6, 50)
    monkeypatch.setattr(line_dedup, "HEAVY", 20)
    assert found(line_dedup.dedup_lines(frame(spark, rows), 2)) == expected(rows)


def test_empty_table(spark):
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


@pytest.mark.parametrize("buckets,n", [(64, 200), (64, 300), (1024, 3900)])
def test_cuckoo_filter(buckets, n):
    """Nothing added is missed, also beyond its room; what is removed goes one by one."""
    rng = np.random.default_rng(n)
    keys = [rng.bytes(16) for _ in range(n)]
    own = CuckooFilter(buckets)
    own.add(b"".join(keys[: n // 2]))
    own = CuckooFilter(buckets, own.slots.tobytes(), own.stash.tobytes())
    own.add(b"".join(keys[n // 2:]))
    assert own.contains(b"".join(keys)).all()
    assert (own.slots != 0).sum() + len(own.stash) == n
    own.remove(b"".join(keys[: n // 3]))
    assert own.contains(b"".join(keys[n // 3:])).all()
    assert (own.slots != 0).sum() + len(own.stash) == n - n // 3
    strange = rng.bytes(16 * 2000)
    assert own.contains(strange).mean() < 0.02
    own.remove(b"".join(keys[n // 3:]))
    assert not (own.slots != 0).any() and not len(own.stash)
