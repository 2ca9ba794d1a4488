"""Corpus operators against brute force and round trips, on small tables with odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fixtures import frame, words
from tollgate.llm import bwt, components, compression, decontam, mixing, multiindex, near_copies, packing, privacy, repeats, simhash, tokens, toxicity, wavelet

@pytest.fixture(scope="module")
def odd_rows():
    base = words(1, 400)
    near = base.replace(base.split()[200], "changed", 1)
    rows = [(1, base, "a"), (2, near, "a"), (3, base, None), (3, base, None), (4, None, "b"), (5, "", "b"), (None, words(2, 30), "c")]
    rows += [(6, words(3, 3000), "a"), (7, "é ß " + words(4, 20), "b"), (8, "x", "b"), (9, words(5, 60) + base[:300], "c")]
    return rows + [(20 + i, words(10 + i, 40), "abc"[i % 3]) for i in range(20)]


# SimHash ---------------------------------------------------------------------


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint():
    for text in (None, "", "One", "a b c", "a b\tc\x0bd", "A b c d A b c d é", words(7, 90)):
        assert simhash.fingerprint(None if text is None else text.encode()) == plain_fingerprint(text)


def test_near_pairs_and_tree_lose_nothing():
    r = np.random.default_rng(5)
    points = np.unique(r.integers(0, 2**63, 3000).astype(np.uint64) ^ r.choice([0, 1, 3, 2**60], 3000).astype(np.uint64))
    points = np.unique(np.concatenate([points, points[:900] ^ np.uint64(0b1011)]))
    got = {(i, j) for s, q in simhash.near_pairs(points, points, 4) for i, j in zip(s.tolist(), q.tolist())}
    want = {(i, j) for i in range(len(points)) for j in np.flatnonzero(np.bitwise_count(points ^ points[i]) <= 4).tolist()}
    assert got == want
    tree = simhash.Tree(points, 4)
    at, home = tree.reach(points, 0)
    home_of = dict(zip(at.tolist(), home.tolist()))
    reach = set(zip(*(x.tolist() for x in tree.reach(points, 4))))
    assert len(home_of) == len(points) and len(set(home_of.values())) > 8
    assert all((i, home_of[j]) in reach for i, j in want)


def test_near_duplicates(spark, odd_rows):
    got = sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(frame(spark, odd_rows)).collect()), key=str)
    fps = [(i, plain_fingerprint(t)) for i, t, _ in odd_rows]
    label = {n: n for n in range(len(fps))}
    while True:
        new = {n: min(label[m] for m in range(len(fps)) if (fps[n][1] ^ fps[m][1]).bit_count() <= 4) for n in label}
        if new == label:
            break
        label = new
    least = {}
    for n, (i, _) in enumerate(fps):
        least[label[n]] = min((x for x in (least.get(label[n]), i) if x is not None), default=None)
    assert got == sorted(((i, f, least[label[n]]) for n, (i, f) in enumerate(fps)), key=str)


def test_one_of_each(spark, odd_rows):
    kept = near_copies.one_of_each(frame(spark, odd_rows))
    assert kept.columns == frame(spark, odd_rows).columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and 1 in ids and not {3, 5} & set(ids)


def test_components(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, k) for k in range(101, 140)] + [(5, 5), (None, 3), (200, 201)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    want = {i: 0 for i in range(1, 31)} | {k: 100 for k in range(101, 140)} | {201: 200}
    assert {k: v for k, v in got.items() if k != v} == want


# tokens ----------------------------------------------------------------------


@pytest.mark.parametrize("n,k", [(0, 3), (1, 1), (64, 2), (900, 37), (5000, 4000)])
def test_wavelet_matrix(n, k):
    ids = np.random.default_rng(n).integers(0, k, n).astype(np.uint32) * 3
    docs, lengths, m = wavelet.unpack(wavelet.pack([5, None], np.array([n // 2, n - n // 2]), ids))
    assert docs == [5, None] and lengths.sum() == n and (m.decode() == ids).all()
    assert (m.access(np.arange(n)) == ids).all()
    for t in {*ids[:15].tolist(), 1}:
        places = np.flatnonzero(ids == t)
        assert m.count(t) == len(places) and m.count(t, n // 3) == (places < n // 3).sum()
        assert (m.places(t) == places).all() and (m.places(t, 1, 3) == places[1:3]).all()


def test_encoder_equals_tokenizer():
    from tokenizers import Tokenizer

    plain, own = Tokenizer.from_file(tokens.vocabulary()), tokens.Encoder(tokens.vocabulary())
    texts = ["", "Don't STOP, it's 42%!!", "a<|endoftext|>b", "ÀÉ ß µª² ½x", "中文 and\x1ctext", "é   z", "''s '' 's, we'll.", "!!! ... ,", words(3, 200)]
    for _ in range(2):
        assert [x.tolist() for x in own(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_output(spark, odd_rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary())
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in tokens.token_output(frame(spark, odd_rows)).collect()))
    rows, at = sorted(((i is not None, i or 0, x or "") for i, x, _ in odd_rows)), 0
    for (known, i, text), g in zip(rows, got, strict=True):
        ids = [*t.encode(text, add_special_tokens=False).ids, 2]
        assert g == (at, i if known else None, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


# toxicity and quality ----------------------------------------------------------


def test_maximal_segments_are_all_and_disjoint():
    def split(scores, lo, hi):
        best = max(((sum(scores[a:b]), a - b, a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=(0, 0, 0, 0))
        if best[0] <= 1e-12:
            return []
        return [*split(scores, lo, best[2]), (best[2], best[3] - 1), *split(scores, best[3], hi)]

    r = random.Random(4)
    for _ in range(150):
        n = r.randint(1, 14)
        places = sorted(r.sample(range(n), r.randint(0, n)))
        own = [r.uniform(-2, 2) for _ in places]
        scores = [-0.25] * n
        for p, s in zip(places, own):
            scores[p] = s
        assert [(a, b) for a, b, _ in toxicity.maximal_segments(places, own, 0.25)] == split(scores, 0, n)


def labelled(spark, mark):
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, mark(words(i, 60), bad), "a"))
        labels.append((i, int(not bad), int(bad)))
    rows += [(None, None, None), (900, "", None), (901, None, "b"), (901, words(9, 5000), "b")]
    return frame(spark, rows), spark.createDataFrame([*labels, (None, 1, 1), (902, None, None)], "doc_id long, quality int, toxic int")


def test_toxicity_held_out(spark):
    docs, labels = labelled(spark, lambda t, bad: f"{t} zzvile zznasty {t}" if bad else f"{t} fine {t}")
    out = toxicity.scored(docs, toxicity.fit(docs, labels), "doc_id").collect()
    assert len(out) == 404 and all(0 <= r.score <= 1 for r in out)
    assert all(r.predicted == (r.doc_id is not None and r.doc_id < 400 and r.doc_id % 4 == 0) for r in out)
    hit = next(r for r in out if r.doc_id == 4)
    assert [(p.first, p.last) for p in hit.passages] == [(60, 61)]


def test_quality_held_out(spark):
    docs, labels = labelled(spark, lambda t, bad: t.replace(" ", "### ") if bad else t)
    out = compression.scored(docs, compression.fit(docs, labels), "doc_id").collect()
    assert len(out) == 404 and all(0 <= r.score <= 1 for r in out)
    right = [(r.score >= 0.3) == (r.doc_id % 4 > 0) for r in out if r.doc_id is not None and r.doc_id < 400]
    assert sum(right) >= 0.98 * len(right)


@pytest.mark.parametrize("module", [toxicity, compression])
def test_fit_without_rows_or_with_one_class(spark, module):
    docs, labels = labelled(spark, lambda t, bad: t)
    none = module.scored(docs, module.fit(docs, labels.where("false")), "doc_id")
    assert all(r.score == 0.5 for r in none.collect())
    one = module.scored(docs.limit(3), module.fit(docs, labels.where("quality = 1")), "doc_id")
    assert len({r.score for r in one.collect()}) == 1
    assert module.scored(docs.where("false"), module.fit(docs.where("false"), labels), "doc_id").count() == 0


# mixing and packing -------------------------------------------------------------


def test_mix_near_targets_and_texts(spark, odd_rows):
    docs = frame(spark, [*odd_rows, *[(100 + i, words(i, 300), "a" if i % 2 else "d") for i in range(40)]])
    out = mixing.mixed(docs).collect()
    by = {}
    for r in out:
        assert 0 <= r.taken <= 2 * r.size
        by.setdefault(r.source, [r.target, 0, r.source_size])[1] += r.taken
    assert all(abs(t - n) <= 2 * mixing.BLOCK and t <= 2 * s + 1e-9 for t, n, s in by.values())
    assert abs(sum(t for t, _, _ in by.values()) - 1.5 * sum(r.size for r in out)) < 1e-6
    texts = mixing.mixed_texts(docs)
    assert texts.columns == docs.columns and {r.size for r in texts.collect()} == {7}
    assert sum(len((r.text or "").split()) for r in texts.collect()) == sum(r.taken for r in out)
    assert sorted(mixing.mixed(docs).collect(), key=str) == sorted(out, key=str)


def test_seats_go_to_the_highest_quotients(spark):
    r = random.Random(12)
    groups = {1: ([5.0] * 7, 10), 2: ([1.0, 1.0, 1.0, 100.0], 3), 3: ([0.4] * 9 + [40.0], 12), 4: ([0.0, 0.0], 5), 5: ([r.random() ** 4 * 50 for _ in range(60)], 77), 6: ([0.6] * 11, 6), 7: ([3.0], 0)}
    rows = [(g, n, v, house) for g, (votes, house) in groups.items() for n, v in enumerate(votes)]
    table = spark.createDataFrame(rows, "g int, party long, votes double, house long")
    got = {(x.g, x.party): x.seats for x in mixing.seats(table, "party", F.col("votes"), F.col("house"), "g").collect()}
    for g, (votes, house) in groups.items():
        won = [0] * len(votes)
        for _ in range(house if any(votes) else 0):
            top = max(range(len(votes)), key=lambda n: (votes[n] / (2 * won[n] + 1), -n))
            won[top] += 1
        assert [got[g, n] for n in range(len(votes))] == won, g


def test_mix_spreads_null_ids(spark):
    docs = frame(spark, [(None, words(i, 5 + i % 90), "a") for i in range(5000)])
    sized = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    out = mixing.apportioned(sized, mixing.source_targets(sized))
    assert out.count() == 5000
    spot = F.pmod(F.col("size"), F.lit(3)).alias("shard")  # three shards of at most 2 000 rows
    counts = [x["count"] for x in sized.groupBy(spot).count().collect()]
    assert len(counts) == 3 and max(counts) < 2000


def test_pack_prefers_room():
    placed = packing.pack(np.array([[5, 5, 5], [4, 4, 4], [3, 3, 3], [2, 2, 2.0]]), 2)
    assert sorted(np.bincount(placed, [5, 4, 3, 2]).tolist()) == [7, 7]
    assert len(packing.pack(np.empty((0, 3)), 4)) == 0


def test_sharding(spark, odd_rows):
    rows = [*odd_rows, *[(1000 + i, "the same text", "a") for i in range(300)], *[(2000 + i, words(i, 50), "a") for i in range(600)]]
    out = packing.sharded(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    for s in range(8):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    sizes = [sum(r.size for r in out if r.shard == s) for s in range(8)]
    assert max(sizes) - min(sizes) <= max(len(t or "") for _, t, _ in rows) + 1
    want = sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in out) == want


def test_small_groups_stay_whole(spark):
    rows = [(i, words(i, 50), "a") for i in range(600)] + [(1000 + i, words(900 + i // 3, 50), "a") for i in range(60)] + [(None, "without ids", "a")] * 400
    out = packing.sharded(frame(spark, rows)).collect()
    where = {}
    for r in out:
        where.setdefault(r.doc_id if r.doc_id is None or r.doc_id < 1000 else 1000 + (r.doc_id - 1000) // 3, set()).add(r.shard)
    assert all(len(where[g]) == 1 for g in range(1000, 1020)) and len(where[None]) == 8


# personal data --------------------------------------------------------------------

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    def luhn(d):
        return sum(v - 9 if v > 9 else v for v in (int(c) * (1 + j % 2) for j, c in enumerate(reversed(d)))) % 10 == 0

    out = []
    for k, p in PLAIN.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            ok = k == "email" or (k == "ip" and all(int(x) <= 255 for x in m.group().split("."))) or (k == "card" and 14 <= len(d) <= 19 and luhn(d)) or (k == "phone" and 10 <= len(d) <= 15)
            out += [(m.start(), list(PLAIN).index(k), m.end(), k)] if ok else []
    return sorted(out)


def test_private_spans(spark, odd_rows):
    texts = ["a.b@c.d-e.fg", "x@y.z_q@w.vu @a.b c@d", "é 1.2.3.4.5.6.7.8 256.1.1.1 001.002.3.255 1.2.3.04", "4785380592391139, 4539-1488 0343-6467 4539148803436468"]
    texts += ["+1 (212) 555.0199- +12 +4912345678901234567 ++49-30-1234567", "9" * 5000, "a" * 20000 + "@", "1.2.3.4@x.yz 4111111111111111@a.b", None, ""]
    rows = [(i, t, "a") for i, t in enumerate(texts)] + odd_rows
    docs = spark.createDataFrame([(n, i, t) for n, (i, t, _) in enumerate(rows)], "row long, doc_id long, text string")
    got = {r.row: [tuple(s)[:4] for s in r.base] for r in privacy.private_spans(docs, "doc_id").collect()}
    assert got == {n: plain_spans(t) for n, (_, t, _) in enumerate(rows)}


def test_terms_that_disclose(spark):
    rows = [(i, f"{words(i, 8)} with Zebulon at ann@b.org or {words(50 + i, 8)}", "a") for i in range(5)]
    rows += [(10 + i, f"{words(80 + i, 20)} with nobody at {words(90 + i, 5)}", "a") for i in range(40)]
    docs = frame(spark, [*rows, (None, None, None)])
    out = {r.doc_id: r.text for r in privacy.sanitised(docs).collect()}
    assert len(out) == 46 and out[None] is None and privacy.sanitised(docs).columns == docs.columns
    for i, t, _ in rows:
        assert out[i] == (t.replace("Zebulon", "").replace("ann@b.org", "[email]") if i < 10 else t)


def test_terms_far_away_and_of_rare_entities(spark):
    # every address stands once; the term stands far from it, twice, and beside no other document's address
    rows = [(i, f"Quillon {words(i, 60)} p{i}@host{i}.org {words(50 + i, 60)} quillon", "a") for i in range(12)]
    rows += [(20 + i, f"{words(80 + i, 60)} nobody {words(200 + i, 5)}", "a") for i in range(120)]
    out = {r.doc_id: r.text for r in privacy.sanitised(frame(spark, rows)).collect()}
    for i, t, _ in rows:
        assert out[i] == (re.sub("[Qq]uillon", "", t).replace(f"p{i}@host{i}.org", "[email]") if i < 12 else t)


def test_terms_within_addresses_and_in_copies(spark):
    # ten copies are one piece of evidence; words of an address are no terms
    copies = [(i, f"{words(1, 30)} ann@examplehost.org", "a") for i in range(10)]
    rows = [*copies, *[(20 + i, f"{words(80 + i, 30)} examplehost", "a") for i in range(5)], *[(40 + i, words(140 + i, 30), "a") for i in range(80)]]
    out = {r.doc_id: r.text for r in privacy.sanitised(frame(spark, rows)).collect()}
    assert all(out[i] == t.replace("ann@examplehost.org", "[email]") for i, t, _ in rows)


# repeats ----------------------------------------------------------------------------


def test_merged_transforms_find_shared_prefixes():
    r = random.Random(3)
    strings = [np.array([r.randint(1, 2) for _ in range(r.randint(0, 40))], np.uint16) for _ in range(30)]
    string, start, interval = bwt.shared_prefixes(strings, 6, shard=64)
    want = {(i, s): strings[i][s : s + 6].tobytes() for i in range(30) for s in range(len(strings[i]) - 5)}
    assert {*zip(string.tolist(), start.tolist())} == set(want)
    by = {}
    for i, s, k in zip(string.tolist(), start.tolist(), interval.tolist()):
        by.setdefault(k, set()).add(want[i, s])
    assert all(len(v) == 1 for v in by.values()) and len(by) == len(set(want.values()))


def test_repeated_bytes_go(spark, odd_rows):
    passage = words(77, 30)
    rows = [*odd_rows, (50, "ab" * 400, "a"), (51, words(51, 50) + passage + words(52, 9), "a"), (52, words(53, 9) + passage + passage + "é" * 120, "b")]
    rows += [(53, words(54, 70) + passage[3:150], None), (54, "é" * 130, None), (55, passage[:99], "a"), (56, words(6, 20)[:99], "a"), (57, words(6, 20)[:99], "a")]
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in repeats.deduplicated(frame(spark, rows)).collect())
    seen, want = set(), []
    for _, _, text in sorted((i is not None, i or 0, t or "") for i, t, _ in rows):
        b = text.encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(b[s : s + 100])
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want.append((len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    ids = [str(i) if i is not None else "None" for i, _, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))]
    assert got == sorted((i, *w) for i, w in zip(ids, want))


# benchmark ------------------------------------------------------------------------------


def test_contaminated(spark, odd_rows):
    items = [words(200 + i, 25) for i in range(6)] + ["tiny it", None, ""]
    edited = items[1][:20] + "Q" + items[1][21:60] + items[1][62:]
    rows = [(100, f"{words(1, 9)} {items[0].upper()} {words(2, 9)}", "a"), (101, edited, "a"), (102, f"{words(3, 8)} {items[2][: len(items[2]) // 2]}", "a")]
    rows += [(103, f"so Tiny \n it was {items[3]} {items[4]}", "b")]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = frame(spark, [*rows, *odd_rows])
    got = {(r.doc_id, r.item_id): r for r in decontam.contaminated(docs, bench, "doc_id").collect()}
    assert set(got) == {(100, 0), (101, 1), (103, 3), (103, 4), (103, 6)}
    assert got[100, 0].edits == 0 and got[101, 1].edits == 3
    hit = got[103, 3]
    assert decontam.normal(rows[3][1])[hit.start : hit.end] == items[3]
    clean = decontam.clean(docs, bench)
    assert clean.columns == docs.columns and clean.count() == len(odd_rows) + 1
    assert decontam.contaminated(docs, bench.where("false"), "doc_id").count() == 0


def test_alignment_is_edit_distance():
    def edits(a, b):
        d = [0] * (len(b) + 1)
        for i, x in enumerate(a):
            e = [i + 1]
            for j, y in enumerate(b):
                e.append(min(e[j] + 1, d[j + 1] + 1, d[j] + (x != y)))
            d = e
        return min(d)

    r = random.Random(8)
    for _ in range(200):
        a, b = ("".join(r.choice("ab") for _ in range(r.randint(1, 12))) for _ in range(2))
        got, _ = decontam.align(decontam.points(a), decontam.points(b), 99, -13, 40)
        assert got == edits(a, b)


# embeddings --------------------------------------------------------------------------------


@pytest.mark.parametrize("cell_size,most_lengths", [(2000, 8), (4, 8), (4, 1)])
def test_near_vectors(spark, monkeypatch, cell_size, most_lengths):
    """One cell and many, vectors of several lengths with codebooks and without."""
    monkeypatch.setattr(multiindex, "CELL_SIZE", cell_size)
    monkeypatch.setattr(multiindex, "MOST_LENGTHS", most_lengths)
    monkeypatch.setattr(multiindex, "CHUNK", 90)
    r = np.random.default_rng(2)
    base = r.normal(size=(150, 8))
    x = np.concatenate([base, base[:60] + r.normal(size=(60, 8)) * 0.1, base[:10]]).astype(np.float32)
    vectors = [v.tolist() for v in x] + [v[:3].tolist() for v in x[:60]] + [[1.0, 2.0]] * 3 + [[2.0, 1.0, 3.0, 0.5]] * 3
    rows = [(i, v, int(i % 150 % 3)) for i, v in enumerate(vectors)]
    odd = [(900, None, 1), (901, [0.0] * 8, 1), (902, [float("nan")] * 8, 1), (903, [None, 1.0], 1), (904, x[0].tolist(), None), (None, x[0].tolist(), 0)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in multiindex.near_vectors(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")).collect()}
    units = [np.array(v, float) / np.linalg.norm(np.array(v, float)) for _, v, _ in rows]
    near = [[j for j, v in enumerate(units) if len(v) == len(u) and rows[i][2] == rows[j][2] and u @ v >= 0.98] for i, u in enumerate(units)]
    least = list(range(len(rows)))
    for _ in range(20):
        least = [min(least[j] for j in n) for n in near]
    want = {i: (len(near[i]) - 1, least[i], least[i] == i) for i in range(len(rows))}
    want |= {i: (0, i, True) for i in range(900, 905)} | {None: (0, None, None)}
    assert got == want


# all -------------------------------------------------------------------------------------------


def test_empty_tables(spark):
    docs = frame(spark, [(1, "a", "b")]).where("false")
    for out in (
        simhash.near_duplicates(docs),
        near_copies.one_of_each(docs),
        tokens.token_output(docs),
        mixing.mixed(docs),
        mixing.mixed_texts(docs),
        packing.sharded(docs),
        privacy.private_spans(docs.withColumnRenamed("row", "r").selectExpr("1L AS row", "text")),
        repeats.deduplicated(docs),
        decontam.clean(docs, spark.createDataFrame([(1, "some item text here")], "item_id long, text string")),
        multiindex.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")),
    ):
        assert out.count() == 0


def test_pipeline_on_small_table(spark, small_dir):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    steps = []
    for name, stage in p.STAGES:
        out = stage(spark, docs, small_dir)
        steps.append((name, out.count()))
        if name != p.STAGES[-1][0]:
            assert out.columns == docs.columns
        docs = out
    # so few labels may teach nothing toxic
    assert steps[0][1] <= 200 and steps[1][1] < steps[0][1] and steps[2][1] < steps[1][1] and steps[3][1] == steps[4][1] > 0


def test_pieces_of_the_vocabulary_spell_themselves():
    """Then no two parts of a token other than those of its own merge can ever stand side by side,
    and ids may serve as ranks."""
    from tokenizers import Tokenizer

    own, plain = tokens.Encoder(tokens.vocabulary()), Tokenizer.from_file(tokens.vocabulary())
    of = {i: t for t, i in plain.get_vocab().items()}
    spelt = {i: s for s, i in own.quick._mergeable_ranks.items()}
    assert len(spelt) > 40_000
    pieces = [s for i, s in spelt.items() if of.get(i, "").endswith("</w>")]
    assert [own.quick._encode_single_piece(s) for s in pieces] == [[i] for i in spelt if of.get(i, "").endswith("</w>")]
    words = [t[:-4] for t in of.values() if t.endswith("</w>") and t[:-4].isascii() and t[:-4].isalpha()]
    assert [x.tolist() for x in own(words)] == [e.ids for e in plain.encode_batch(words, add_special_tokens=False)]


def test_encoder_on_random_texts():
    from tokenizers import Tokenizer

    plain, own = Tokenizer.from_file(tokens.vocabulary()), tokens.Encoder(tokens.vocabulary())
    r = random.Random(5)
    some = "abcdeghilmnoprstuvwxyzABCXYZ019 \n\t'''.,!?-\"#@éèñöüßÀÉÑÖÞþ" + "sttdmrevell"
    texts = ["".join(r.choice(some) for _ in range(r.randint(0, 50))) for _ in range(8000)] + ["x\x7fy", "ÿ × ÷", "\x0bx", "á", "'s's", "''s", "1's", "!'s"]
    got = [y for i in range(0, len(texts), 50) for y in own(texts[i : i + 50])]
    assert [x.tolist() for x in got] == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
