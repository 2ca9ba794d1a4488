"""Alignment of two vocabularies against plain loops over tokens."""

import hashlib
from collections import Counter

import pytest

from fixtures import frame, words
from tollgate.llm import alignment
from tollgate.llm.tokens import vocabulary

ODD = ["", None, " ", "\n\n  x", "a<|endoftext|>b", "<s> </s> <unk> <0x0A>", "▁ under ▁", "naïve café №½", "中文字 👩‍👩‍👧 ‍", "\x00\x01 nul", "don't we'll I'M", "12345 1 22", "é ﻿ bom", "　wide space", " trailing  "]


@pytest.fixture(scope="module")
def sides():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(vocabulary(alignment.BYTE_BPE))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=vocabulary(alignment.PIECE_BPE))


def plain_tokens(sides, text):
    """[(id, end)] of both sides, or none."""
    from tokenizers import decoders

    a, b = sides
    byte_of = {}
    n = 0
    for x in range(256):
        if 33 <= x <= 126 or 161 <= x <= 172 or x >= 174:
            byte_of[chr(x)] = x
        else:
            byte_of[chr(256 + n)] = x
            n += 1
    assert decoders.ByteLevel().decode([c for c in byte_of if byte_of[c] < 128]) == bytes(v for v in byte_of.values() if v < 128).decode()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if not text or b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
        return [], []
    out = []
    for ids, parts in ((ids_a, bytes_a), (ids_b, bytes_b)):
        at, side = 0, []
        for i, p in zip(ids, parts):
            at += len(p)
            side.append((i, at))
        out.append(side)
    return tuple(out)


def plain_rows(sides, rows):
    tokens = [plain_tokens(sides, t or "") for _, t, _ in rows]
    links = [[(i, j) for i, e in a for j, f in b if e == f] for a, b in tokens]
    count = Counter(x for found in links for x in found)
    most = Counter()
    for (_, j), n in count.items():
        most[j] = max(most[j], n)
    out = []
    for (doc, _, _), (a, b), found in zip(rows, tokens, links):
        groups, cut = [], 0
        for e in sorted({e for _, e in a} & {e for _, e in b}):
            groups.append("|".join(",".join(str(i) for i, f in side if cut < f <= e) for side in (a, b)))
            cut = e
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        out.append((doc, len(a), len(b), len(groups), len(found), sum(count[x] == most[x[1]] for x in found), sum(count[x] for x in found), digest))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [0, 40, 2**19])
def test_alignment_equals_plain_loops(spark, sides, hot, monkeypatch):
    monkeypatch.setattr(alignment, "HOT_PAIRS", hot)
    monkeypatch.setattr(alignment, "HELD_PAIRS", 500)
    monkeypatch.setattr(alignment.measured_texts, "__defaults__", (hot,))
    rows = [(i, t, "a") for i, t in enumerate(ODD)] + [(100 + i, words(i, 60) + " " + ODD[i % 15 or 2], None) for i in range(30)]
    rows += [(200 + i, "one text of a third of all rows", "a") for i in range(30)] + [(3, ODD[3], "a"), (3, ODD[3], "a"), (None, words(1, 20), None), (300, words(9, 700), "b")]
    rows = [(i, t, s) for i, t, s in rows]
    got = alignment.aligned_documents(frame(spark, rows))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_rows(sides, rows)


def test_long_white_space_and_runs(sides):
    align = alignment.Aligner(vocabulary(alignment.BYTE_BPE), vocabulary(alignment.PIECE_BPE))
    for text in (" " * 1_200_000 + "x", "a" * 300_000, "x\n" * 50_000):
        a, _ = align.sides
        assert a(text) == sides[0].encode(" " + text, add_special_tokens=False).ids
        assert align(text) is None or align(text)[0] == len(a(text))


def test_byte_tokens_equal_the_library(sides):
    a = alignment.ByteTokens(vocabulary(alignment.BYTE_BPE))
    for text in [t for t in ODD if t] + [words(5, 300), "'s 'S  \t\t x" * 30]:
        assert a(text) == sides[0].encode(" " + text, add_special_tokens=False).ids


def test_texts_without_tokens(spark):
    docs = frame(spark, [(1, None, "a"), (2, "", "a"), (3, "▁", "a")])
    assert sorted(map(tuple, alignment.aligned_documents(docs).collect())) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2, 3)]
    assert alignment.aligned_documents(docs.where("false")).count() == 0
