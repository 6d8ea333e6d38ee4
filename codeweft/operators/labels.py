"""Label propagation over numbered nodes within one task."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

_P1, _P2, _P3, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))

#: Links that are gone over at once, which bounds the memory of a round; a node's links stay together.
PART = 1_000_000


def hash_int(number: int, seed: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of one more integer column after those that gave ``seed``."""
    left = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    x = (seed.view(np.uint64) + (_P5 + np.uint64(4))) ^ (np.full(1, number, np.uint64) * _P1)
    x = left(x, 23) * _P2 + _P3
    x = (x ^ (x >> np.uint64(33))) * _P2
    x = (x ^ (x >> np.uint64(29))) * _P3
    return (x ^ (x >> np.uint64(32))).view(np.int64)


def _places(begin: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the links of ``nodes``, and for each the index of its node in ``nodes``."""
    n = begin[nodes + 1] - begin[nodes]
    of = np.repeat(np.arange(len(nodes)), n)
    return np.arange(len(of)) - np.repeat(np.cumsum(n) - n - begin[nodes], n), of


def _parts(begin: np.ndarray, nodes: np.ndarray) -> list[np.ndarray]:
    return np.split(nodes, np.flatnonzero(np.diff(np.cumsum(begin[nodes + 1] - begin[nodes]) // PART)) + 1)


def _wanted(nodes: np.ndarray, begin: np.ndarray, b: np.ndarray, w: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The label with most links to each of ``nodes``, its own counting once more, the least on ties."""
    at, of = _places(begin, nodes)
    size = np.int64(len(label))
    key = np.concatenate((of * size + label[b[at]], np.arange(len(nodes)) * size + label[nodes]))
    order = np.argsort(key)
    key, vote = key[order], np.concatenate((w[at], np.ones(len(nodes), w.dtype)))[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    key, vote = key[first], np.add.reduceat(vote, first)
    of = key // size
    first = np.flatnonzero(np.diff(of, prepend=-1))
    most = np.maximum.reduceat(vote, first)
    top = np.flatnonzero(vote == most[of])
    return key[top[np.flatnonzero(np.diff(of[top], prepend=-1))]] % size


def propagate(a: np.ndarray, b: np.ndarray, w: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """The label of each node, by the rule of :func:`codeweft.operators.analytics.communities`.

    ``a``, ``b`` and ``w`` are the two nodes and the edges of each link, given once; nodes are
    numbered from 0 in the order of their names, whose hashes are ``seed``. After the first round
    only the nodes beside one that moved, and that one, are counted again: no other has new votes.
    """
    size = len(seed)
    a, b, w = np.concatenate((a, b)), np.concatenate((b, a)), np.concatenate((w, w))
    order = np.argsort(a, kind="stable")
    begin = np.searchsorted(a[order], np.arange(size + 1))
    b, w = b[order], w[order]
    del a, order
    label = np.arange(size)
    to, again, r = label.copy(), np.arange(size), 0
    while len(again):
        for part in _parts(begin, again):
            to[part] = _wanted(part, begin, b, w, label)
        would = to != label
        nodes = np.flatnonzero(would)
        if not len(nodes):
            break
        h = np.zeros(size, np.int64)
        h[nodes] = hash_int(r, seed[nodes])
        held = np.zeros(size, bool)
        for part in _parts(begin, nodes):
            at, of = _places(begin, part)
            other, own = b[at], part[of]
            held[own[would[other] & ((h[other] < h[own]) | ((h[other] == h[own]) & (other < own)))]] = True
        moved = nodes[~held[nodes]]
        label[moved] = to[moved]
        beside = np.zeros(size, bool)
        beside[moved] = True
        for part in _parts(begin, moved):
            beside[b[_places(begin, part)[0]]] = True
        again, r = np.flatnonzero(beside), r + 1
    return label


def labelled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, community) from rows (a, b, n): links with their edges, and nodes without b with their hashes."""
    links, nodes = [], []
    for batch in batches:
        a, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
        link = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
        nodes.append((a[~link], n[~link]))
        if link.any():
            links.append((a[link].astype(np.int32), batch.column(1).drop_null().to_numpy().astype(np.int32), n[link]))
    if not links:
        return
    seed = np.zeros(sum(len(i) for i, _ in nodes), np.int64)
    for i, h in nodes:
        seed[i] = h
    a, b, w = (np.concatenate(x) for x in zip(*links))
    links.clear()
    nodes.clear()
    label = propagate(a, b, w, seed)
    for i in range(0, len(label), 100_000):
        part = label[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(i, i + len(part))), pa.array(part)], ["node", "community"])
