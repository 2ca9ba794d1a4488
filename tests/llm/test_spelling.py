"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from fixtures import frame
from tollgate.llm import spelling


def plain_words(rows):
    counts = Counter()
    for i, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(a == b[:k] + b[k + 1 :] for k in range(len(b)))


def plain_variants(counts):
    form, n_near = {}, {}
    for w, n in counts.items():
        found = [x for x in counts if near(w, x)]
        top = min(found, key=lambda x: (-counts[x], x), default=None)
        form[w] = top if top is not None and counts[top] >= 2 * n else None
        n_near[w] = len(found)

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n, n_near[w], counts[form[w]] if form[w] else None) for w, n in counts.items())


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    stems = ["".join(r.choice("abé") for _ in range(r.randint(4, 8))) for _ in range(120)] + ["aaaaa", "aaaaaa", "aaaaaaa", "ababab", "bababa", "b" * 3000, "b" * 3001, "c" + "b" * 3000]
    out = []
    for i in range(150):
        picked = [r.choice(stems) * 1 for _ in range(r.choice([5, 40]))]
        picked = [w.upper() if r.random() < 0.1 else w for w in picked]
        picked += [w[:k] + r.choice(["", "x", "ÿ", "é"]) + w[k + 1 :] for w in picked if r.random() < 0.3 for k in [r.randrange(len(w))]]
        out.append((i, r.choice([" ", "-", "1"]).join(picked), "a"))
    return [*out, out[3], out[3], (None, out[5][1], None), (900, None, "a"), (901, "", "a"), (902, "ÀÉÎ àéî ABCDE×÷", "a"), (903, "hapax-legomenon", "b")]


@pytest.mark.parametrize("most", [10_000, 40, 3])
def test_variants_equal_brute_force(spark, rows, most):
    got = spelling.variants(spelling.run_counts(frame(spark, rows)).where("n >= 3"), most=most)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect())) == plain_variants(plain_words(rows))


def test_one_partition_holds_most_words(spark):
    r = random.Random(3)
    hot = {"commonbeginning" + "".join(r.choice("ab") for _ in range(r.randint(1, 7))): r.randint(3, 60) for _ in range(120)}
    counts = {**hot, **{w[:k] + "z" + w[k:]: 3 for w in list(hot)[:40] for k in (0, 5, 14, 15)}, "zzzzzz": 4}
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert sorted(map(tuple, spelling.variants(table, most=10).collect())) == plain_variants(counts)
    sizes = spelling.partitions(table, 10).groupBy("key").count().collect()
    assert max(s["count"] for s in sizes) <= 10


def test_acceptor_is_minimal_and_numbers_words():
    words = sorted({"tap", "taps", "top", "tops", "stop", "stops", "t"})
    a = spelling.Acceptor(words)
    assert a.count[a.start] == len(words) and len(a.arcs) == 7
    for number, word in enumerate(words):
        state, at = a.start, 0
        for letter in word:
            state, more = a.arcs[state][letter]
            at += more
        assert a.final[state] and at == number
    pairs = {tuple(sorted((words[i], words[j]))) for i, j in zip(*a.near_pairs())}
    assert pairs == {(x, y) for x in words for y in words if x < y and near(x, y)} and len(a.near_pairs()[0]) == len(pairs)


def test_no_words(spark):
    docs = frame(spark, [(1, None, "a"), (2, "one two", "a")])
    assert spelling.spelling_variants(docs).count() == 0 == spelling.spelling_variants(docs.where("false")).count()
