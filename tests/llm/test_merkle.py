"""The manifest against trees built by hand."""

import hashlib
import zlib

import pytest

from panelry.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hash string, tree int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    doc_id, text, lang, source, n_chars = row[:5]
    n_chars = None if n_chars is None else n_chars + more
    fields = (doc_id, source, lang, n_chars, text)
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields])


def way_up(hashes):
    """Siblings of every place with their side, and the top."""
    ways, places, level = [[] for _ in hashes], list(range(len(hashes))), list(hashes)
    while len(level) > 1:
        for way, at in zip(ways, places):
            way.append((level[at ^ 1] if at ^ 1 < len(level) else None, at & 1))
        places = [at >> 1 for at in places]
        level = [h(*level[i:i + 2]) for i in range(0, len(level), 2)]
    return ways, level[0]


def expected(rows):
    by_lang = {}
    for row in rows:
        by_lang.setdefault(row[2], []).append(row)
    order = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in order:
        own = sorted(by_lang[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append((own, *way_up([leaf(r) for r in own])))
    top_ways, root = way_up([t[2] for t in trees])
    out = []
    for (own, ways, subroot), top_way in zip(trees, top_ways):
        for row, way in zip(own, ways):
            siblings = way + top_way
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            folded = leaf(row, int(tampered))
            for other, right in siblings:
                folded = h(folded) if other is None else h(other, folded) if right else h(folded, other)
            proof = h(*[s for s, _ in siblings if s])
            out.append((row[0], leaf(row), subroot, root, proof, folded, folded == root))
    return sorted(out, key=repr)


def found(df):
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted([tuple(r[n] for n in names) for r in df.collect()], key=repr)


def rows_of(n, langs):
    return [(i * 3 - 5, f"text é {i}\n" * (i % 4), langs[i * i % len(langs)], f"s{i % 3}", i if i % 5 else None, "x", 1)
            for i in range(n)]


ODD = [
    (None, "a", "en", None, 3, "x", 1), (None, None, "en", None, None, "x", 1), (7, "", None, "s", 9, "x", 1),
    (7, "", None, "s", 9, "x", 1), (7, "", None, "s", 9, "x", 1), (7, "other", None, "s", 9, "x", 1),
    (9, "long " * 60000, "é", "s", 2 ** 63 - 1, "x", 1), (10, "y", "z", "s", 1, "x", 1),
]


@pytest.mark.parametrize("rows", [rows_of(37, ["en", "fr", "de"]) + ODD, rows_of(1, ["en"]), rows_of(9, ["en"]),
                                  rows_of(8, list("abcdefgh"))])
def test_manifest_of_small_tables(spark, rows):
    assert found(merkle.manifest(spark.createDataFrame(rows, SCHEMA))) == expected(rows)


@pytest.mark.parametrize("heavy", [3, 4096])
def test_strides_and_the_shuffled_way(spark, monkeypatch, heavy):
    """Short strides make many stored levels; with no row broadcast unseen, nodes are parted by weight."""
    monkeypatch.setattr(merkle, "STRIDE", 2)
    monkeypatch.setattr(merkle, "HEAVY", heavy)
    rows = rows_of(45, ["en", "fr", "en", "de"]) + ODD
    assert found(merkle.manifest(spark.createDataFrame(rows, SCHEMA), broadcast_rows=0)) == expected(rows)


def test_empty_table(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_the_row_limit_is_put_back(spark):
    spark.conf.set(merkle.ROW_LIMIT, "1234")
    merkle.manifest(spark.createDataFrame(rows_of(3, ["en"]), SCHEMA))
    assert spark.conf.get(merkle.ROW_LIMIT) == "1234"
    spark.conf.unset(merkle.ROW_LIMIT)
