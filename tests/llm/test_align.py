"""Alignment against a plain loop over both libraries' tokens."""

import collections
import hashlib

import numpy as np
import public_tokenizers as public
import pytest

from panelry.llm import align

A_PATH, B_PATH = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")
DOC = "doc_id long, text string, chunk long, pair string, a int, docs string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2, "y") for i, t in rows], DOC)


@pytest.fixture(scope="module")
def tools():
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(A_PATH)
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=B_PATH)


def expected(rows, tools):
    first, second = tools
    letters = align.byte_letters()
    docs, counts = [], collections.Counter()
    for doc_id, text in rows:
        groups = []
        if text:
            source = (" " + text).encode()
            a_ids = first.encode(" " + text, add_special_tokens=False).ids
            b_ids = second.encode(text)
            a = [bytes(letters[c] for c in first.id_to_token(i)) for i in a_ids]
            b = [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode()
                 for i, p in ((i, second.id_to_piece(i)) for i in b_ids)]
            if b"".join(a) == source == b"".join(b):
                ends_a, ends_b = np.cumsum([len(x) for x in a]), np.cumsum([len(x) for x in b])
                i = j = 0
                for end in sorted(set(ends_a) & set(ends_b)):
                    k, l = list(ends_a).index(end, i) + 1, list(ends_b).index(end, j) + 1
                    groups.append((a_ids[i:k], b_ids[j:l]))
                    i, j = k, l
        links = collections.Counter((x, y) for g, h in groups for x in g for y in h)
        counts.update(set(links))
        docs.append((doc_id, groups, links))
    most = collections.Counter()
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    out = []
    for doc_id, groups, links in docs:
        line = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((doc_id, sum(len(g) for g, _ in groups), sum(len(h) for _, h in groups), len(groups),
                    sum(links.values()), sum(n for p, n in links.items() if counts[p] == most[p[0]]),
                    sum(n * counts[p] for p, n in links.items()), line))
    return sorted(out, key=repr)


def found(df):
    names = "doc_id n_a n_b n_groups n_links n_best count_sum groups".split()
    return sorted([tuple(r[n] for n in names) for r in df.collect()], key=repr)


WORDS = ("the tokenizers étaient größer naïve 東京 привет 👩‍👩‍👧 12345 !!! supercalifragilistic aaaa\n\n don't  x\ty "
         "<|endoftext|> </s> <0x41> ▁ ﬁ ① São").split(" ")
ODD = [
    (None, "no id"), (None, None), (1, None), (2, ""), (3, " "), (3, "  leading"), (4, "trailing  "), (5, "\x00\x01\x7f"),
    (6, "same row"), (6, "same row"), (7, "﻿bom"), (8, "é combining"), (9, "a" * 3000), (10, "<|endoftext|>"),
    (11, "<s>[INST] </s><unk>"), (12, "ab c" * 5000),
]


def corpus(seed, n):
    rng = np.random.default_rng(seed)
    return [(100 + i, " ".join(rng.choice(WORDS, rng.integers(1, 30)))) for i in range(n)]


@pytest.mark.parametrize("chunk_bytes", [1, 1 << 20])
def test_against_plain_loop(spark, tools, chunk_bytes):
    rows = corpus(1, 40) + ODD
    got = align.align(frame(spark, rows).repartition(3), A_PATH, B_PATH, chunk_bytes=chunk_bytes)
    assert found(got) == expected(rows, tools)


def test_digest_and_empty_table(spark):
    row = align.align(frame(spark, [(1, "a test"), (2, None)]), A_PATH, B_PATH, digest=True).orderBy("doc_id").collect()
    plain = align.align(frame(spark, [(1, "a test")]), A_PATH, B_PATH).first()
    assert row[0].groups == hashlib.sha256(plain.groups.encode()).hexdigest() and row[1].groups == ""
    assert align.align(frame(spark, []), A_PATH, B_PATH).count() == 0


@pytest.mark.parametrize("text", ["a" * 2_000_000, " " * 2_000_000 + "x", "\n!" * 500_000, "word " * 300_000])
def test_very_long_texts_keep_the_library_ids(tools, text):
    with open(A_PATH, "rb") as a, open(B_PATH, "rb") as b:
        first = align.vocabularies(a.read(), b.read())[0]
    assert first(" " + text).tolist() == tools[0].encode(
        " " + text, add_special_tokens=False).ids


def test_common_ends_against_sets():
    rng = np.random.default_rng(4)
    for n, m in ((1, 1), (1, 50), (300, 300), (2000, 40), (37, 9000)):
        last = 40 * max(n, m)
        a = np.unique(np.append(rng.integers(1, last, n), last))
        b = np.unique(np.append(rng.integers(1, last, m), last))
        ia, ib = align.common_ends(a, b, np.array([len(a)]), np.array([len(b)]))
        assert (a[ia] == b[ib]).all() and a[ia].tolist() == sorted(set(a) & set(b))


def test_wide_groups_are_counted_by_their_ids(monkeypatch):
    rng = np.random.default_rng(6)
    a, b = rng.integers(0, 9, 60), rng.integers(0, 9, 80)
    a_first, a_n, b_first, b_n = np.array([0, 10, 11]), np.array([10, 1, 49]), np.array([0, 30, 31]), np.array([30, 1, 49])
    doc = np.array([0, 1, 1])
    plain = collections.Counter((int(d) * 9 + int(x)) * 9 + int(y) for d, s, n, t, m in zip(doc, a_first, a_n, b_first, b_n)
                                for x in a[s:s + n] for y in b[t:t + m])
    for wide, expanded in ((1 << 12, 1 << 22), (40, 7), (1 << 12, 100), (1, 1)):
        monkeypatch.setattr(align, "WIDE", wide)
        monkeypatch.setattr(align, "EXPANDED", expanded)
        codes, times = align.linked_pairs(doc, a, b, 9, a_first, a_n, b_first, b_n)
        assert dict(zip(codes.tolist(), times.tolist())) == plain
