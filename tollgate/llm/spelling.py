"""Spelling variants: the words of a corpus composed with a one-edit transducer and themselves.

The composed machine reads a word on one side and a near word on the other; its states are (p, 0, p)
while the edit is unspent and (p, 1, q) afterwards, p and q being states of the vocabulary. It is cut
at its initial states: the words that share a beginning are one partition, whose minimised acceptor is
built and composed in a task, and the pairs that spend their edit within the beginning, where both
sides must go on with the same letters, meet by these letters.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollgate.llm.registry import query, table
from tollgate.session import checkpointed

#: Runs of letters after A-Z are lower-cased, and which of them lose a letter.
RUN = "[a-zÀ-ÿ]+"
DAMAGE = 97
SHORTEST = 5
RAREST = 3
#: A form is at least so many times as frequent as its variant.
RATIO = 2
#: Distinct words that a task holds before it hands their counts on, and most words of a partition
#: before it is cut by the next letter.
HELD_WORDS = 200_000
PARTITION_WORDS = 20_000


def run_counts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shortest: int = SHORTEST, damage: int = DAMAGE) -> DataFrame:
    """(word, n): how often a word of at least ``shortest`` code points occurs in whole texts.

    Of a document's runs, those whose crc32 of ``<id>:<run>`` is divisible by ``damage`` lose one
    letter. Null texts hold no words, a null id is written as nothing, repeated rows count again.
    """
    rows = docs.where(F.col(text).isNotNull()).select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text).alias("text"))
    find = re.compile(RUN).findall

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def hand_on() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for name, body in zip(batch.column(0), batch.column(1)):
                head = zlib.crc32(f"{name.as_py()}:".encode())
                # only ASCII letters of bytes are lower-cased
                for run, n in Counter(find(body.as_buffer().to_pybytes().lower().decode())).items():
                    if len(run) < shortest:
                        continue
                    h = zlib.crc32(run.encode(), head)
                    if h % damage == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < shortest:
                            continue
                    held[run] = held.get(run, 0) + n
                if len(held) > HELD_WORDS:
                    yield hand_on()
                    held.clear()
        yield hand_on()

    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Acceptor:
    """Minimal acyclic acceptor of sorted distinct words.

    States are numbered children first. ``arcs`` of a state gives the next state by letter, and how
    many of the state's words sort before those of the arc; so a path adds up to a word's number.
    """

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self.count: list[int] = []
        known: dict[tuple, int] = {}
        path: list[tuple[list[bool], dict[str, int]]] = [([False], {})]
        last = ""

        def close(to: int) -> None:
            """The states of the last word beyond its first ``to`` letters will not change any more."""
            while len(path) > to + 1:
                (final,), arcs = path.pop()
                path[-1][1][last[len(path) - 1]] = self._state(known, final, arcs)

        for word in words:
            same, most = 0, min(len(word), len(last))
            while same < most and word[same] == last[same]:
                same += 1
            close(same)
            path.extend(([False], {}) for _ in word[same:])
            path[-1][0][0] = True
            last = word
        close(0)
        self.start = self._state(known, *path[0][0], path[0][1])

    def _state(self, known: dict[tuple, int], final: bool, arcs: dict[str, int]) -> int:
        shape = (final, *arcs.items())
        if shape not in known:
            known[shape] = len(self.arcs)
            at, placed = int(final), {}
            for letter, to in arcs.items():
                placed[letter] = (to, at)
                at += self.count[to]
            self.arcs.append(placed)
            self.final.append(final)
            self.count.append(at)
        return known[shape]

    def common(self, p: int, q: int) -> list[tuple[int, int]]:
        """Composed states (p, 1, q): numbers of the words that both states accept."""
        out, work = [], [(p, q, 0, 0)]
        while work:
            p, q, i, j = work.pop()
            if p == q:
                out.extend((i + t, j + t) for t in range(self.count[p]))
                continue
            if self.final[p] and self.final[q]:
                out.append((i, j))
            a, b = self.arcs[p], self.arcs[q]
            for letter in a.keys() & b.keys():
                (c, x), (d, y) = a[letter], b[letter]
                work.append((c, d, i + x, j + y))
        return out

    def near_pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all pairs of words one edit apart, each once.

        A pair spends its edit where its words first differ: by a replaced letter, or by a letter
        of one word that the other lacks and does not go on with. What follows a state (p, 0, p)
        depends on p alone and is worked out once for all paths that lead there.
        """
        none = np.empty((0, 2), np.int64)
        pairs: list[np.ndarray] = []
        met: dict[tuple[int, int], list[tuple[int, int]]] = {}

        def common(p: int, q: int) -> list[tuple[int, int]]:
            if (p, q) not in met:
                met[p, q] = self.common(p, q)
            return met[p, q]

        for arcs, final in zip(self.arcs, self.final):
            own = []
            for (c, x), (d, y) in combinations(arcs.values(), 2):
                own += [(x + i, y + j) for i, j in common(c, d)]
            for letter, (c, x) in arcs.items():
                if final and self.final[c]:
                    own.append((x, 0))
                on = self.arcs[c]
                for other in on.keys() & arcs.keys():
                    if other != letter:
                        (d, y), (e, z) = on[other], arcs[other]
                        own += [(x + y + i, z + j) for i, j in common(d, e)]
            if len(met) > 500_000:
                met.clear()
            parts = [pairs[c] + x for c, x in arcs.values() if len(pairs[c])]
            if own:
                parts.append(np.array(own, np.int64))
            pairs.append(none if not parts else parts[0] if len(parts) == 1 else np.concatenate(parts))
        return pairs[self.start][:, 0], pairs[self.start][:, 1]


def partitions(words: DataFrame, most: int = PARTITION_WORDS) -> DataFrame:
    """``words`` (word, n) with ``key``, the beginning that names a word's partition, and ``spent``,
    the numbers of letters after which partitions on the way there were cut.

    A partition of more than ``most`` words is cut by the first letter in which its words differ.
    There are at most count / ``most`` such partitions at a time, and only they are broadcast.
    """
    rows = checkpointed(words.select("word", "n", F.lit("").alias("key"), F.array().cast("array<int>").alias("spent"), F.lit(True).alias("open")))
    low, high = F.col("low"), F.col("high")
    same = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length(low), F.length(high)))),
        F.lit(0),
        lambda n, i: F.when((n == i - 1) & (F.substring(low, i, F.lit(1)) == F.substring(high, i, F.lit(1))), i).otherwise(n),
    )
    while True:
        sizes = rows.where("open").groupBy("key").agg(F.count("*").alias("size"), F.min("word").alias("low"), F.max("word").alias("high"))
        crowded = checkpointed(sizes.where(F.col("size") > most).select("key", same.alias("at")))
        if crowded.isEmpty():
            return rows.select("word", "n", "key", "spent")
        joined = rows.join(F.broadcast(crowded), "key", "left")
        cut = F.col("at").isNotNull()
        rows = checkpointed(
            joined.select(
                "word",
                "n",
                F.when(cut, F.left("word", F.col("at") + 1)).otherwise(F.col("key")).alias("key"),
                F.when(cut, F.concat("spent", F.array("at"))).otherwise(F.col("spent")).alias("spent"),
                cut.alias("open"),
            )
        )


def _composed(unit: pa.Table) -> pa.Table:
    """(word, n_near, best_n, best) of one partition's words that have near words in it."""
    unit = unit.select(["word", "n"]).take(pc.sort_indices(unit.column("word")))
    words, n = unit.column("word").to_pylist(), unit.column("n").to_numpy()
    i, j = Acceptor(words).near_pairs()
    near = np.bincount(i, minlength=len(words)) + np.bincount(j, minlength=len(words))
    order = np.argsort(-n, kind="stable")  # ties stay in code-point order
    place = np.empty(len(words), np.int64)
    place[order] = np.arange(len(words))
    best = np.full(len(words), len(words))
    np.minimum.at(best, i, place[j])
    np.minimum.at(best, j, place[i])
    some = np.flatnonzero(near)
    best = order[best[some]]
    return pa.table({"word": pa.array([words[k] for k in some], pa.string()), "n_near": near[some], "best_n": n[best], "best": pa.array([words[k] for k in best], pa.string())})


def _spent(parted: DataFrame) -> DataFrame:
    """The same for pairs of words that first differ where partitions were cut.

    Both sides go on alike after the edit: the word without its letter there equals the other
    without its own, or the other itself. Such a group has at most one word per letter of the
    alphabet and one more.
    """
    rows = parted.select("word", "n", F.explode("spent").alias("at"))
    letter = F.substring("word", F.col("at") + 1, F.lit(1))
    without = F.concat(F.left("word", F.col("at")), F.substring("word", F.col("at") + 2, F.length("word")))
    sides = F.array(F.struct(without.alias("rest")), F.struct(F.col("word").alias("rest")))
    rows = rows.select("at", F.explode(F.when(letter == "", F.slice(sides, 2, 1)).otherwise(sides)).alias("side"), letter.alias("letter"), "word", "n")
    member = F.struct((-F.col("n")).alias("less"), "word", "letter")
    groups = rows.groupBy("at", "side.rest").agg(F.array_sort(F.collect_list(member)).alias("all")).where(F.size("all") > 1)
    each = groups.select("all", F.explode("all").alias("own"))
    near = F.filter("all", lambda x: x["letter"] != F.col("own.letter"))
    each = each.select("own.word", near.alias("near")).where(F.size("near") > 0)
    return each.select("word", F.size("near").cast("long").alias("n_near"), (-F.get("near", F.lit(0))["less"]).alias("best_n"), F.get("near", F.lit(0))["word"].alias("best"))


def variants(words: DataFrame, ratio: int = RATIO, most: int = PARTITION_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct (word, n): how many words are one inserted,
    deleted or replaced code point away, the most frequent of them if it is ``ratio`` times as
    frequent (of equals the first in code-point order), and where following forms ends.
    No words give no rows.
    """
    parted = partitions(words, most)
    found = parted.select("key", "word", "n").groupBy("key").applyInArrow(_composed, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    near = found.union(_spent(parted)).groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    rows = parted.select("word", "n").join(near, "word", "left")
    formed = -F.col("best.less") >= ratio * F.col("n")
    rows = checkpointed(
        rows.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best.best")).alias("form"), F.when(formed, -F.col("best.less")).alias("form_n")
        )
    )
    # every step at least multiplies n by the ratio, so doubling the steps ends after a few rounds
    steps = rows.where("form is not null").select("word", F.col("form").alias("to"))
    while True:
        on = steps.select(F.col("word").alias("to"), F.col("to").alias("next"))
        steps = checkpointed(steps.join(on, "to", "left").select("word", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
        if steps.where("moved").isEmpty():
            break
        steps = steps.select("word", "to")
    ends = steps.select("word", F.col("to").alias("root"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``variants`` of the words of at least ``SHORTEST`` code points and ``RAREST`` occurrences."""
    words = run_counts(docs, id_col, text)
    return variants(words.where(F.col("n") >= RAREST))


@query("op11_spelling_composition")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))
