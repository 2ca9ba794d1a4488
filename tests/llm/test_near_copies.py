"""Near copies against the exact similarity of all pairs of texts."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fixtures import frame, words
from tollgate.llm import near_copies
from tollgate.llm.components import components
from tollgate.llm.simhash import shingle_hashes


def exact_pairs(texts, least=0.8):
    """All pairs of a similarity of ``least``: such sets share one of the smallest hashes of either."""
    sets = [np.unique(shingle_hashes((t or "").encode(), 5)).tolist() for t in texts]
    beginnings = defaultdict(list)
    for n, s in enumerate(sets):
        for h in s[: len(s) - int(np.ceil(least * len(s))) + 1]:
            beginnings[h].append(n)
    maybe = {(a, b) for group in beginnings.values() for x, a in enumerate(group) for b in group[x + 1 :]}
    whole = [set(s) for s in sets]
    return [(a, b) for a, b in maybe if len(whole[a] & whole[b]) >= least * len(whole[a] | whole[b])]


def found_groups(spark, texts):
    rows = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "key long, text string").withColumn("mixed", F.xxhash64("text"))
    some = near_copies._with_text(near_copies._sketches(rows, 5), rows)
    group = {r.node: r.component for r in components(near_copies.similar_links(some), "a", "b").collect()}
    return [group.get(r.mixed, r.mixed) for r in rows.orderBy("key").collect()]


def check(spark, texts, recall):
    pairs, group = exact_pairs(texts), found_groups(spark, texts)
    assert pairs and sum(group[a] == group[b] for a, b in pairs) >= recall * len(pairs)
    up = list(range(len(texts)))

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in pairs:
        up[root(a)] = root(b)
    exact = defaultdict(set)
    for n, g in enumerate(group):
        exact[g].add(root(n))
    assert all(len(g) == 1 for g in exact.values())  # nothing hangs together that is not similar


def test_recall_against_all_pairs(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").distinct().orderBy("text").collect()]
    check(spark, texts, 0.95)


def test_edited_copies_in_one_crowded_group(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "CHUNK", 60)
    monkeypatch.setattr(near_copies, "TEXTS", 50)
    r = random.Random(2)
    base = words(1, 300).split()
    texts = []
    for _ in range(180):
        copy = base[:]
        for at in r.sample(range(300), r.choice([1, 3, 6, 9])):
            copy[at] = words(r.random(), 1)
        texts.append(" ".join(copy))
    texts = [*dict.fromkeys(texts), *(words(50 + i, 120) for i in range(40))]
    check(spark, texts, 0.95)


def test_one_stays(spark):
    base = words(3, 200)
    rows = [(7, base, "a"), (4, base.replace(base.split()[90], "other", 1), "b"), (4, base.upper(), "b"), (9, None, "a"), (8, "", "a"), (10, " \n", "a"), (None, "short text", "a"), (11, "short text", None)]
    rows += [(20, words(8, 30), "a"), (20, words(8, 30), "a"), (21, words(9, 3), "a"), (None, words(10, 40), "a"), (None, words(10, 40), "a")]
    docs = frame(spark, rows).withColumn("a.b", F.lit(1)).withColumn("print", F.lit(2)).withColumn("mixed", F.lit(3)).withColumn("key", F.lit(4))
    kept = near_copies.one_of_each(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([4, 8, 11, 20, 21, None])
    assert near_copies.one_of_each(docs.where("false")).count() == 0


@pytest.mark.parametrize("a,b,want", [([], [], 1.0), ([], [1], 0.0), ([1, 2, 3], [2, 3, 4], 0.5)])
def test_similarity(a, b, want):
    assert near_copies.similarity(np.array(a, np.uint64), np.array(b, np.uint64)) == want
