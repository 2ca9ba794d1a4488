"""Burrows-Wheeler transforms of shards of strings, merged by refining their interleave."""

from __future__ import annotations

import numpy as np


def transform(strings: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a shard (symbols of all strings end to end, 0 after each): the suffixes in order of
    their first ``depth`` symbols at least, by prefix doubling, and the symbol before each."""
    n = len(strings)
    rank, reach = strings.astype(np.int64), 1
    order = np.argsort(strings, kind="stable")
    while reach < depth:
        after = np.zeros(n, np.int64)
        after[: max(0, n - reach)] = rank[reach:] + 1
        key = rank * (int(rank.max(initial=0)) + 3) + after
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]])) if n else 0
        rank, reach = new, 2 * reach
    return order, strings[order - 1]


def merge(shards: list[tuple[np.ndarray, np.ndarray]], depth: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Merge shards' transforms without sorting suffixes again.

    The interleave tells from which shard each suffix of the merged order comes. A step takes
    the places of the merged transform in order of their symbol, stably: what was in order of
    the first k symbols is then in order of k + 1. A boundary between neighbours that first
    shows in step k + 1 has a common prefix of k, so the places between boundaries after
    ``depth`` steps are the intervals of suffixes that share ``depth`` symbols. Returned are,
    for each shard, the merged places of its suffixes in its own order, and the interval of each merged place.
    """
    source = np.repeat(np.arange(len(shards), dtype=np.uint8 if len(shards) < 256 else np.int32), [len(o) for o, _ in shards])
    interval = np.zeros(len(source), np.int32)
    symbols = np.empty(len(source), np.uint16)
    for _ in range(depth):
        # suffixes of one shard keep their order, so its transform is dealt out as it is
        deal = np.argsort(source, kind="stable")
        symbols[deal] = np.concatenate([b for _, b in shards])
        order = np.argsort(symbols, kind="stable")
        source, symbol, was = source[order], symbols[order], interval[order]
        interval = np.cumsum(np.concatenate([[0], (symbol[1:] != symbol[:-1]) | (was[1:] != was[:-1])]), dtype=np.int32)
    return [np.flatnonzero(source == j) for j in range(len(shards))], interval


def shared_prefixes(strings: list[np.ndarray], depth: int, shard: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, start, interval) of every place of the strings (symbols above 0) from which
    ``depth`` symbols follow; equal intervals hold exactly the places with the same symbols."""
    lengths = np.array([len(s) for s in strings])
    cut = np.flatnonzero(np.diff(np.cumsum(lengths + 1) // shard, prepend=0)) if len(strings) else []
    parts = np.split(np.arange(len(strings)), cut)
    shards, firsts = [], []
    for part in parts:
        if len(part):
            text = np.zeros(int((lengths[part] + 1).sum()), np.uint16)
            at = np.cumsum(lengths[part] + 1) - (lengths[part] + 1)
            for i, a in zip(part, at):
                text[a : a + lengths[i]] = strings[i]
            shards.append(transform(text, depth))
            firsts.append((part, at))
    places, interval = merge(shards, depth)
    out = []
    for (order, _), place, (part, at) in zip(shards, places, firsts):
        i = np.searchsorted(at, order, side="right") - 1
        start = order - at[i]
        full = start + depth <= lengths[part[i]]
        out.append((part[i][full], start[full], interval[place][full]))
    return tuple(np.concatenate([o[c] for o in out]) for c in range(3)) if out else (np.empty(0, np.int64),) * 3
