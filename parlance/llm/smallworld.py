"""Hierarchical navigable small-world graphs over unit vectors, built and searched many vectors at a time.

A node's top layer is drawn by a hash of its number; nodes are ordered so that each layer holds the first so many. A layer
is built in batches: each batch searches the layer as it stands, meets its own members directly, links each node to diverse
near ones and is linked back, and lists that overflow are thinned by the same rule."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from .words import U, mix

#: Links a node keeps in a layer; in the lowest, twice as many. Width of the beam while building; nodes inserted at once.
LINKS, BUILD, BATCH = 12, 48, 512
#: Candidates a beam takes up at once.
STEP = 4


class Graph(NamedTuple):
    x: np.ndarray  # (n + 1, d) float32 unit vectors in the graph's order, and a row of zeros
    layers: list[np.ndarray]  # from the lowest: (m, links) numbers of nodes, m where there is none


def order(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the nodes of these numbers, higher layers first, and how many nodes each layer holds, lowest first."""
    drawn = mix(mix(numbers.astype(U)) + U(0x1234567))
    u = ((drawn >> U(11)).astype(float) + 0.5) / float(1 << 53)
    level = np.minimum(np.floor(-np.log(u) / np.log(LINKS)), 8).astype(np.int64)
    at = np.lexsort((drawn, -level))
    return at, np.array([int((level >= k).sum()) for k in range(int(level.max(initial=0)) + 1)])


def beam(x: np.ndarray, links: np.ndarray, asked: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, near), nearest first, of a beam of `width` for each asked vector, from its start nodes; -1 where a beam is not
    full. A beam ends when all that it holds are taken up."""
    m, q = len(links), len(asked)
    ids, near, done = np.full((q, width), m, np.int64), np.full((q, width), -np.inf, np.float32), np.ones((q, width), bool)
    seen = np.zeros((q, m + 1), bool)
    seen[:, m] = True
    active, fresh = np.arange(q), start
    while len(active):
        fresh = np.sort(fresh, axis=1)
        new = ~seen[active[:, None], fresh]
        new[:, 1:] &= fresh[:, 1:] != fresh[:, :-1]
        r, c = np.nonzero(new)
        node = fresh[r, c]
        seen[active[r], node] = True
        value = np.full(fresh.shape, -np.inf, np.float32)
        value[r, c] = np.einsum("pd,pd->p", asked[active[r]], x[node])
        both = np.concatenate([near[active], value], axis=1)
        top = np.argsort(-both, axis=1, kind="stable")[:, :width]
        near[active] = np.take_along_axis(both, top, 1)
        ids[active] = np.take_along_axis(np.concatenate([ids[active], np.where(new, fresh, m)], axis=1), top, 1)
        done[active] = np.take_along_axis(np.concatenate([done[active], ~new], axis=1), top, 1)
        active = active[~done[active].all(1)]
        if len(active):
            pick = np.argsort(done[active], axis=1, kind="stable")[:, :STEP]
            live = ~np.take_along_axis(done[active], pick, 1)
            done[active[:, None], pick] = True
            nodes = np.where(live, np.take_along_axis(ids[active], pick, 1), m)
            fresh = np.where((nodes < m)[:, :, None], links[np.minimum(nodes, m - 1)], m).reshape(len(active), -1)
    ids[near == -np.inf] = -1
    return ids, near


def diverse(x: np.ndarray, ids: np.ndarray, near: np.ndarray, keep: int) -> np.ndarray:
    """Of each row's candidates (-1: none) at most `keep`: first those nearer to the row's vector than to any one chosen
    before, then the nearest of the rest; -1 fills up."""
    at = np.argsort(-near, axis=1, kind="stable")[:, : 2 * max(keep, BUILD)]
    ids, near = np.take_along_axis(ids, at, 1), np.take_along_axis(near, at, 1)
    some = ids >= 0
    v = x[np.where(some, ids, len(x) - 1)]
    mutual = v @ v.transpose(0, 2, 1)
    chosen, cover = np.zeros(ids.shape, bool), np.full(ids.shape, -np.inf, np.float32)
    for c in range(ids.shape[1]):
        chosen[:, c] = some[:, c] & (near[:, c] > cover[:, c])
        np.maximum(cover, np.where(chosen[:, c, None], mutual[:, :, c], -np.inf), out=cover)
    rank = np.argsort(np.where(chosen, 0, np.where(some, 1, 2)), axis=1, kind="stable")[:, :keep]
    out = np.full((len(ids), keep), -1)
    out[:, : rank.shape[1]] = np.take_along_axis(ids, rank, 1)
    return out


def _insert(x: np.ndarray, links: np.ndarray, a: int, b: int, ids: np.ndarray, near: np.ndarray) -> None:
    """Link the nodes a to b with their candidates, and these back."""
    m, width = len(links), links.shape[1]
    chosen = diverse(x, ids, near, max(width // 2, 1))
    links[a:b, : chosen.shape[1]] = np.where(chosen < 0, m, chosen)
    source, slot = np.nonzero(chosen >= 0)
    target, source = chosen[source, slot], source + a
    value = np.einsum("pd,pd->p", x[target], x[source])
    by = np.lexsort((-value, target))
    target, source, value = target[by], source[by], value[by]
    which, first, many = np.unique(target, return_index=True, return_counts=True)
    place = np.arange(len(target)) - np.repeat(first, many)
    fits = place < 2 * width  # of more new links to one node than that, the nearest count
    row = np.repeat(np.arange(len(which)), many)[fits]
    more = np.full((len(which), int(min(many.max(initial=0), 2 * width))), -1)
    sims = np.full(more.shape, -np.inf, np.float32)
    more[row, place[fits]], sims[row, place[fits]] = source[fits], value[fits]
    old = links[which]
    has = old < m
    old_sims = np.where(has, np.einsum("td,tkd->tk", x[which], x[np.where(has, old, len(x) - 1)]), -np.inf).astype(np.float32)
    old = np.where(has, old, -1)
    # a node of this batch may have chosen the one that now links back
    twice = (more[:, :, None] == old[:, None, :]).any(2)
    more[twice], sims[twice] = -1, -np.inf
    ids, near = np.concatenate([old, more], axis=1), np.concatenate([old_sims, sims], axis=1)
    over = (ids >= 0).sum(1) > width
    kept = np.full((len(which), width), -1)
    at = np.argsort(ids < 0, axis=1, kind="stable")[:, :width]
    kept[:, : at.shape[1]] = np.take_along_axis(ids, at, 1)
    for i in range(0, int(over.sum()), BATCH):
        some = np.flatnonzero(over)[i : i + BATCH]
        kept[some] = diverse(x, ids[some], near[some], width)
    links[which] = np.where(kept < 0, m, kept)


def build(x: np.ndarray, sizes: np.ndarray) -> Graph:
    """The graph of unit vectors in the order and with the layer sizes that `order` gave."""
    x = np.concatenate([x.astype(np.float32), np.zeros((1, x.shape[1]), np.float32)])
    layers: list[np.ndarray] = []
    for k in range(len(sizes) - 1, -1, -1):
        m, width = int(sizes[k]), LINKS * (2 if k == 0 else 1)
        links = np.full((m, width), m, np.int64)
        above = int(sizes[k + 1]) if k + 1 < len(sizes) else 0
        a = 0
        while a < m:
            b = min(m, a + min(BATCH, max(a, 64)))
            within = x[a:b] @ x[a:b].T
            np.fill_diagonal(within, -np.inf)
            take = min(BUILD, b - a)
            best = np.argpartition(-within, take - 1, axis=1)[:, :take]
            near = np.take_along_axis(within, best, 1)
            ids = np.where(near > -np.inf, best + a, -1)
            if a:
                start = descend(x, layers, x[a:b])[:, :1] if above and a >= above else np.zeros((b - a, 1), np.int64)
                found, value = beam(x, links, x[a:b], start, BUILD)
                ids, near = np.concatenate([found, ids], axis=1), np.concatenate([value, near], axis=1)
            _insert(x, links, a, b, ids, near)
            a = b
        layers.insert(0, links)
    return Graph(x, layers)


def descend(x: np.ndarray, layers: list[np.ndarray], asked: np.ndarray, width: int = 8) -> np.ndarray:
    """The nearest nodes (at most `width`) that a way down the given layers, lowest first, leads to."""
    start = np.zeros((len(asked), 1), np.int64)
    for links in layers[::-1]:
        ids, _ = beam(x, links, asked, start, width)
        start = np.where(ids < 0, ids[:, :1], ids)
    return start


def search(graph: Graph, asked: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, near) of the beam of `width` in the lowest layer for each asked unit vector, nearest first; -1 fills up."""
    ids, near = np.zeros((len(asked), width), np.int64), np.zeros((len(asked), width), np.float32)
    for a in range(0, len(asked), BATCH):
        part = asked[a : a + BATCH].astype(np.float32)
        start = descend(graph.x, graph.layers[1:], part)
        ids[a : a + BATCH], near[a : a + BATCH] = beam(graph.x, graph.layers[0], part, start, width)
    return ids, near
