"""Toxicity: maximal scoring passages over token log-odds, calibrated by extreme values."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tollgate.llm.labelled import Logistic, held_out, training_rows
from tollgate.llm.registry import query, table

#: Most labelled rows used for the fit.
FIT_ROWS = 20_000
#: Strength of the Dirichlet prior, in documents; pieces count from so many standard errors and
#: such log-odds on, for common words that merely differ by language carry little and are many.
PRIOR = 100.0
SIGNIFICANT = 4.0
LEAST_ODDS = 2.0
#: What any other word takes off a passage.
DRIFT = 0.2
#: A passage is reported if so few as good are expected in a clean text of the same length.
EXPECTED = 0.01
#: Longest beginning of a word that has a weight; words whose weights a worker remembers.
LONGEST = 6
REMEMBERED = 150_000
EULER = 0.5772156649

WORDS = re.compile(r"[^\W\d_]+").findall


def words_of(text: str | None) -> list[str]:
    return WORDS((text or "").lower())


def maximal_segments(places: list[int], scores: list[float], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) of a sequence in which the given places
    have scores of their own and every other place scores -drift, in one pass.

    Each candidate keeps the running total before (l) and after (r) it; a new one is joined with
    the nearest earlier candidate that starts lower, as long as that one also ends lower.
    """
    found: list[list[float]] = []  # first, last, l, r
    total, at = 0.0, -1
    for place, score in zip(places, scores):
        total -= drift * (place - at - 1)
        at = place
        before, total = total, total + score
        if score <= 0:
            continue
        new = [place, place, before, total]
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= new[2]:
                j -= 1
            if j < 0 or found[j][3] >= new[3]:
                break
            new = [found[j][0], place, found[j][2], total]
            del found[j:]
            j -= 1
        found.append(new)
    return [(int(a), int(b), r - l) for a, b, l, r in found]


def pieces_of(word: str) -> list[str]:
    """What a word is weighed by: itself and its beginnings, since invective is compounded."""
    return [f"{word}$", *(word[:n] for n in range(3, min(len(word), LONGEST) + 1))]


class Model:
    """Weights of pieces, the extreme-value law of the best passage of a clean text, the scale.

    A word takes the log-odds of its most telling piece.
    """

    def __init__(self, weights: dict[str, tuple[float, float]], rates: dict[str, float]):
        self.weights, self.log_k, self.logistic = weights, 0.0, None
        self.decay = _decay([(rates[w], s) for w, (s, _) in weights.items()])
        self.known: dict[str, float | None] = {}

    def weigh(self, word: str) -> float | None:
        found = [self.weights[p] for p in pieces_of(word) if p in self.weights]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        score = self.known[word] = max(found, key=lambda x: abs(x[0]))[0] if found else None
        return score

    def passages(self, words: list[str]) -> list[tuple[int, int, float]]:
        for w in set(words).difference(self.known):
            self.weigh(w)
        get = self.known.get
        places = [i for i, s in enumerate(map(get, words)) if s is not None]
        return maximal_segments(places, [get(words[i]) for i in places])

    def excess(self, score: float, length: int) -> float:
        """-ln of how many passages as good a clean text of that length is expected to hold."""
        return self.decay * score - self.log_k - math.log(max(length, 1))

    def row(self, score: float, length: int) -> list[float]:
        """Features of a text by its best passage, of any score and of a score chance hardly gives."""
        best = min(max(self.excess(score, length), -10.0), 40.0) if score > 0 else -10.0
        return [best, float(best > -math.log(EXPECTED))]


def _decay(rates: list[tuple[float, float]]) -> float:
    """The positive root of sum p exp(x s) = 1 over the scores of a clean text."""
    rest = 1 - sum(p for p, _ in rates)

    def over(x: float) -> bool:
        return sum(p * math.exp(min(x * s, 500)) for p, s in rates) + rest * math.exp(-x * DRIFT) > 1

    if not any(s > 0 for _, s in rates):
        return 1.0
    lo, hi = 1e-6, 1.0
    while not over(hi) and hi < 1e3:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if over(mid) else (mid, hi)
    return hi


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = FIT_ROWS) -> Model:
    """Fit from labelled rows that are not held out; only words, labels and lengths are used.

    Words are counted once per distinct text. Their log-odds between the classes have a
    Dirichlet prior in proportion to the words' overall frequency. Null texts, ids and labels teach
    nothing, repeated rows no more than one; without rows, or with one class, every text has the base rate.
    """
    rows = training_rows(docs, labels, label, most).groupBy(F.xxhash64("text").alias("mixed")).agg(F.first("text").alias("text"), F.max("label").alias("label"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked, plain = Counter(), Counter()
        for batch in batches:
            for text, mark in zip(batch.column("text"), batch.column("label").to_pylist()):
                words = words_of(text.as_py())
                into = marked if mark else plain
                into.update({p for w in set(words) for p in pieces_of(w)})
                into[""] += 1
                into[" "] += len(words)
        words = list(marked.keys() | plain.keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(words, pa.string()), pa.array([marked[w] for w in words], pa.int64()), pa.array([plain[w] for w in words], pa.int64())], names=["word", "marked", "plain"]
        )

    counts = rows.mapInArrow(count, "word string, marked long, plain long").groupBy("word").agg(F.sum("marked").alias("marked"), F.sum("plain").alias("plain"))
    counts = counts.persist()
    try:
        sums = {r.word: r for r in counts.where("word in ('', ' ')").collect()}
        if "" not in sums:
            model = Model({}, {})
            model.logistic = Logistic(np.zeros((0, 2)), np.zeros(0))
            return model
        n, m = float(sums[""].marked), float(sums[""].plain)
        length = max(float(sums[" "].plain), 1.0)
        prior = PRIOR * (F.col("marked") + F.col("plain")) / (n + m)
        a, b = F.col("marked") + prior, F.col("plain") + prior
        odds = F.log(a / F.greatest(n + PRIOR - a, F.lit(0.5))) - F.log(b / F.greatest(m + PRIOR - b, F.lit(0.5)))
        z = odds / F.sqrt(1 / a + 1 / b)
        chosen = counts.where("word not in ('', ' ')").select("word", odds.alias("odds"), z.alias("z"), (b / length).alias("rate"))
        chosen = chosen.where((F.abs("z") >= SIGNIFICANT) & (F.abs("odds") >= LEAST_ODDS)).orderBy("word").collect()
    finally:
        counts.unpersist()
    model = Model({r.word: (r.odds, r.z) for r in chosen}, {r.word: r.rate for r in chosen})

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("text"):
                words = words_of(text.as_py())
                out.append((max((s for _, _, s in model.passages(words)), default=0.0), len(words)))
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.float64()), pa.array([k for _, k in out], pa.int64()), batch.column("label").cast(pa.int64())], names=["score", "length", "label"])

    # at most FIT_ROWS rows of three numbers
    got = rows.select("text", "label").mapInArrow(measure, "score double, length long, label long").collect()
    clean = [r for r in got if not r.label and r.length]
    # moments of the extreme-value law: E[decay * best] = ln(K n) + Euler's constant
    gaps = [model.decay * r.score - math.log(r.length) for r in clean]
    model.log_k = float(np.mean(gaps)) - EULER if gaps else 0.0
    x = [model.row(r.score, r.length) for r in got]
    model.logistic = Logistic(np.array(x).reshape(-1, 2), np.array([r.label for r in got]))
    return model


def scored(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """The columns ``keep`` with score, predicted, n_passages and passages (first and last word,
    excess) of every row. Null and empty texts hold no passage and score like any clean text;
    repeated rows and an empty table are ordinary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, spans = [], []
            for text in batch.column(0):
                words = words_of(text.as_py())
                found = model.passages(words)
                rows.append(model.row(max((s for _, _, s in found), default=0.0), len(words)))
                marks = [(a, b, model.excess(s, len(words))) for a, b, s in found]
                spans.append([{"first": a, "last": b, "excess": m} for a, b, m in marks if m > -math.log(EXPECTED)])
            score = model.logistic(np.array(rows).reshape(-1, 2))
            kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("excess", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(score), pa.array(spans, kind)], names=[*batch.schema.names[1:], "score", "passages"])

    chosen = docs.select(F.col("text").alias("__text"), *[F.col(f"`{c}`") for c in keep])
    more = T._parse_datatype_string("score double, passages array<struct<first:bigint,last:bigint,excess:double>>")
    out = chosen.mapInArrow(run, T.StructType([*chosen.schema.fields[1:], *more.fields]))
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0)).withColumn("n_passages", F.size("passages"))


@query("op3_toxic_segments")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model, "doc_id").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_passages")
