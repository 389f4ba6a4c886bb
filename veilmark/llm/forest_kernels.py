"""Arrow kernels of the projection forest: fit, routing, search through one priority queue, reranking."""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pyarrow as pa


def matrix(column):
    """Rows of a list column as float64."""
    n, column = len(column), column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.float64) if n else np.zeros((0, 0))


class Forest:
    """Complete trees: inner node i of a tree has a direction and a place to cut, its children are 2i + 1 and 2i + 2.

    Trees see vectors with one more component that gives all the same norm, and queries with 0 there, so that the
    largest inner product is the smallest angle.
    """

    def __init__(self, trees, depth, norm2, planes, cuts):
        self.trees, self.depth, self.norm2, self.planes, self.cuts = trees, depth, norm2, planes, cuts
        self.leaves = 1 << depth

    def lifted(self, x):
        return np.hstack([x, np.sqrt(np.maximum(0.0, self.norm2 - (x * x).sum(axis=1)))[:, None]])

    def leaves_of(self, x):
        """Leaf of each vector in each tree."""
        y = self.lifted(x).astype(np.float32)
        out = np.zeros((len(y), self.trees), dtype=np.int32)
        for t in range(self.trees):
            node = np.zeros(len(y), dtype=np.int64)
            for _ in range(self.depth):
                right = np.einsum("ij,ij->i", y, self.planes[t][node]) >= self.cuts[t][node]
                node = 2 * node + 1 + right
            out[:, t] = node - (self.leaves - 1)
        return out

    def margins(self, queries):
        """Signed distance of each query from each inner node's cut."""
        y = np.hstack([queries, np.zeros((len(queries), 1))]).astype(np.float32)
        return [y @ self.planes[t].T - self.cuts[t] for t in range(self.trees)]

    def order(self, queries):
        """For each query all leaves (tree * leaves + leaf) in the order of one queue over all trees: the least cut crossed on the way comes first."""
        every = []
        for d in self.margins(queries):
            crossed = np.zeros((len(d), 1), dtype=np.float32)
            while crossed.shape[1] < self.leaves:
                here = d[:, crossed.shape[1] - 1 : 2 * crossed.shape[1] - 1]
                far = np.maximum(crossed, np.abs(here))
                crossed = np.stack([np.where(here >= 0, far, crossed), np.where(here >= 0, crossed, far)], axis=2).reshape(len(d), -1)
            every.append(crossed)
        return np.argsort(np.hstack(every), axis=1, kind="stable")

    def state(self):
        """What the constructor takes: plain arrays, so that executors need no copy of this package for a broadcast."""
        return self.trees, self.depth, self.norm2, self.planes, self.cuts


def fit(sample, trees, depth, norm2, seed):
    """Random directions, each cut at the median of the sample's vectors in its node."""
    rng = np.random.default_rng(seed)
    inner, dims = (1 << depth) - 1, sample.shape[1] + 1
    forest = Forest(trees, depth, norm2, [], [])
    y = forest.lifted(sample).astype(np.float32)
    for _ in range(trees):
        planes = rng.normal(size=(inner, dims)).astype(np.float32)
        planes /= np.maximum(np.linalg.norm(planes, axis=1, keepdims=True), 1e-12)
        cuts = np.zeros(inner, dtype=np.float32)
        members = {0: np.arange(len(y))}
        for node in range(inner):
            mine = members.pop(node)
            at = y[mine] @ planes[node]
            cuts[node] = np.median(at) if len(at) else 0.0
            members[2 * node + 1], members[2 * node + 2] = mine[at < cuts[node]], mine[at >= cuts[node]]
        forest.planes.append(planes)
        forest.cuts.append(cuts)
    return forest


def _names(column):
    """A 128-bit name of each vector's bytes."""
    x = matrix(column)
    return [hashlib.blake2b(row.tobytes(), digest_size=16).digest() for row in x]


def namer():
    """The columns, then the name of the vector."""

    def run(batches):
        for batch in batches:
            names = _names(batch.column(batch.schema.get_field_index("vector")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.binary())], names=[*batch.schema.names, "name"])

    return run


def distinct(keep, flush=50_000):
    """(name, vector, ids): each different vector of a task with its smallest ids, so that copies never meet in one place by the row."""

    def run(batches):
        held = {}

        def out(schema):
            names = list(held)
            vectors = pa.concat_arrays([held[k][0] for k in names])
            part = pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), vectors, pa.array([held[k][1] for k in names], pa.list_(pa.int64()))], names=["name", "vector", "ids"])
            held.clear()
            return part

        for batch in batches:
            column = batch.column(batch.schema.get_field_index("vector"))
            ids = batch.column(batch.schema.get_field_index("id")).to_pylist()
            for i, name in enumerate(_names(column)):
                if name not in held:
                    held[name] = (column.slice(i, 1), [ids[i]])
                    continue
                mine = held[name][1]
                mine.append(ids[i])
                if len(mine) > 8 * keep:
                    mine[:] = sorted(set(mine))[:keep]
            if len(held) >= flush:
                yield out(batch.schema)
        if held:
            yield out(None)

    return run


def router(forest, shelves):
    """tree, shelf, leaf, name, ids, vector: a row for each vector and tree; a shelf is a run of neighbouring leaves."""

    def run(batches):
        f = Forest(*forest.value)
        per = f.leaves // shelves
        for batch in batches:
            leaves = f.leaves_of(matrix(batch.column(batch.schema.get_field_index("vector"))))
            rows = [batch.column(batch.schema.get_field_index(c)) for c in ("name", "ids", "vector")]
            for t in range(f.trees):
                leaf = leaves[:, t]
                head = [pa.array(np.full(len(leaf), t * shelves, np.int32) + leaf // per), pa.array(t * f.leaves + leaf)]
                yield pa.RecordBatch.from_arrays([*head, *rows], names=["shelf", "leaf", "name", "ids", "vector"])

    return run


def scores(rows, query):
    """Inner products in double precision, summed in the order of the components whatever else is asked."""
    return (rows * query).sum(axis=1)


def best(x, ids, q, keep):
    """(score, id) of the keep best copies of the vectors, ties to smaller ids."""
    rough = x @ q
    if len(rough) > keep:
        cut = np.partition(rough, len(rough) - keep)[len(rough) - keep]
        at = np.flatnonzero(rough >= cut - 1e-9 * max(1.0, abs(float(cut))))
    else:
        at = np.arange(len(rough))
    found = [(-s, i) for s, k in zip(scores(x[at], q).tolist(), at.tolist(), strict=True) for i in ids[k]]
    return sorted(found)[:keep]


def exact(queries, forest, keep):
    """q, score, id, leaves: the best of a task for a few broadcast queries, by looking at every vector."""

    def run(batches):
        found = [[] for _ in queries.value]
        for batch in batches:
            x = matrix(batch.column(batch.schema.get_field_index("vector")))
            ids = batch.column(batch.schema.get_field_index("ids")).to_pylist()
            leaves = None
            for k, (_, q) in enumerate(queries.value):
                got = best(x, ids, q, keep)
                if got:
                    leaves = Forest(*forest.value).leaves_of(x) if leaves is None else leaves
                    where = {i: n for n, own in enumerate(ids) for i in own} if not k else where
                    found[k] = sorted([*found[k], *[(s, i, leaves[where[i]].tolist()) for s, i in got]])[:keep]
        rows = [{"q": k, "score": -s, "id": i, "leaves": own} for k, mine in enumerate(found) for s, i, own in mine]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("q", pa.int32()), ("score", pa.float64()), ("id", pa.int64()), ("leaves", pa.list_(pa.int32()))]))

    return run


def places(forest, query):
    """Place of each leaf (tree * leaves + leaf) in the query's order of visits."""
    order = forest.order(query[None, :])[0]
    at = np.empty(len(order), dtype=np.int64)
    at[order] = np.arange(len(order))
    return at


def searcher(forest, shelves, sizes, budget, least, block=256):
    """name, vector, shelf, leaves: the leaves each query visits, a row for each shelf.

    Visits go on until ``budget`` leaves are seen and one tree has shown ``least`` different vectors or all.
    """

    def run(batches):
        f, counts = Forest(*forest.value), sizes.value
        per, flat = f.leaves // shelves, counts.ravel()
        enough = min(least, counts[0].sum())
        for batch in batches:
            x = matrix(batch.column(batch.schema.get_field_index("vector")))
            rows, shelf, leaves, ends = [], [], [], [0]
            for at in range(0, len(x), block):
                for k, order in enumerate(f.order(x[at : at + block]), at):
                    upto = budget
                    if np.bincount(order[:upto] // f.leaves, flat[order[:upto]], f.trees).max() < enough:
                        own = order // f.leaves
                        upto = max(upto, min(int(np.searchsorted(np.cumsum(np.where(own == t, flat[order], 0)), enough)) for t in range(f.trees)) + 1)
                    mine = np.sort(order[:upto][flat[order[:upto]] > 0])
                    on, first = np.unique(mine // per, return_index=True)
                    rows.append(np.full(len(on), k))
                    shelf.append(on)
                    ends.extend((ends[-1] + np.append(first[1:], len(mine))).tolist() if len(on) else [])
                    leaves.append(mine)
            at = pa.array(np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64), pa.int64())
            own = [batch.column(batch.schema.get_field_index(c)).take(at) for c in ("name", "vector")]
            joined = lambda parts: np.concatenate([np.zeros(0, dtype=np.int64), *parts]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*own, pa.array(joined(shelf)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(joined(leaves)))], names=["name", "vector", "shelf", "leaves"])

    return run


FOUND = pa.list_(pa.struct([("worse", pa.float64()), ("id", pa.int64())]))


def _ranks(groups):
    """Place of each row inside its group; the rows of a group lie together."""
    first = np.flatnonzero(np.append(True, groups[1:] != groups[:-1])) if len(groups) else np.zeros(0, dtype=np.int64)
    return np.arange(len(groups)) - np.repeat(first, np.diff(np.append(first, len(groups))))


def _listed(names, owner, worse, ids):
    """name, found of rows that are sorted by owner, a place in names."""
    on, first = np.unique(owner, return_index=True)
    offsets = pa.array(np.append(first, len(owner)).astype(np.int32))
    kept = pa.StructArray.from_arrays([pa.array(worse, pa.float64()), pa.array(ids, pa.int64())], names=["worse", "id"])
    return names.take(pa.array(on, pa.int64())), pa.ListArray.from_arrays(offsets, kept).cast(FOUND)


def _leading(x, q, leaf, visited, owner, keep, cells=1 << 22):
    """(query, row): the rows x that may be among the keep best of a query in the leaves that it visits; leaf and visited are sorted.

    Each leaf meets its queries in one matrix product, in single precision where the range allows; what comes within the error of a query's
    keep-th best so far stays.
    """
    most, norm = np.sqrt((x * x).sum(axis=1).max()), np.sqrt((q * q).sum(axis=1))
    single = 1e-28 < most * norm.min() and max(most, norm.max(), most * norm.max()) < 1e30
    kind = np.float32 if single else np.float64
    slack = ((x.shape[1] + 8) * float(np.finfo(kind).eps) * 2 * most * norm).astype(kind)
    x, q = x.astype(kind), q.astype(kind)
    bar = np.full(len(q), -np.inf, dtype=kind)
    held = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=kind))]

    def tightened():
        who, row, s = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((-s, who))
        who, row, s = who[order], row[order], s[order]
        last = np.flatnonzero(_ranks(who) == keep - 1)
        bar[who[last]] = s[last]
        stay = s >= bar[who] - slack[who]
        return [(who[stay], row[stay], s[stay])]

    first = np.flatnonzero(np.append(True, leaf[1:] != leaf[:-1]))
    size, waiting, step = 0, 0, 1
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(leaf)], strict=True):
        asked = owner[np.searchsorted(visited, leaf[a]) : np.searchsorted(visited, leaf[a], side="right")]
        for c in range(0, len(asked), max(1, cells // (b - a))):
            mine = asked[c : c + max(1, cells // (b - a))]
            s = q[mine] @ x[a:b].T
            new = np.flatnonzero(np.isneginf(bar[mine]))
            if len(new) and b - a > keep:
                bar[mine[new]] = np.partition(s[new], b - a - keep, axis=1)[:, b - a - keep]
            i, j = np.nonzero(s >= (bar[mine] - slack[mine])[:, None])
            held.append((mine[i], a + j, s[i, j]))
            waiting += len(i)
        size += 1
        if size == step or waiting > 1 << 22:
            held, waiting, step = tightened(), 0, max(step, 2 * size)
    return tightened()[0][:2]


def reranker(keep):
    """name, found (score, id): the best vectors of a shelf part for the queries that visit it."""

    def run(vectors, asked):
        n, m = vectors.num_rows, asked.num_rows
        if not n or not m:
            return pa.table({"name": pa.array([], pa.binary()), "found": pa.array([], FOUND)})
        leaf = vectors["leaf"].to_numpy()
        order = np.argsort(leaf, kind="stable")
        x, q, leaf = matrix(vectors["vector"])[order], matrix(asked["vector"]), leaf[order]
        lists = vectors["ids"].combine_chunks().take(pa.array(order))
        ids, starts = lists.values.to_numpy(), lists.offsets.to_numpy()
        leaves = asked["leaves"].combine_chunks()
        visited, owner = leaves.flatten().to_numpy(), np.repeat(np.arange(m), np.diff(leaves.offsets.to_numpy()))
        order = np.argsort(visited, kind="stable")
        who, row = _leading(x, q, leaf, visited[order], owner[order], keep)
        worse = np.concatenate([np.zeros(0), *[-(x[row[a : a + 65_536]] * q[who[a : a + 65_536]]).sum(axis=1) for a in range(0, len(row), 65_536)]])
        copies = starts[row + 1] - starts[row]
        near = np.repeat(np.arange(len(row)), copies)
        each = ids[starts[row][near] + _ranks(near)]
        order = np.lexsort((each, worse[near], who[near]))
        order = order[_ranks(who[near][order]) < keep]
        names, found = _listed(asked["name"].combine_chunks(), who[near][order], worse[near][order], each[order])
        return pa.table({"name": names, "found": found})

    return run


def merger(keep, flush=1 << 20):
    """name, found: the keep best different (score, id) of all lists of a name; a task holds all lists of its names, by turns cut to keep."""

    def run(batches):
        places, held, waiting = {}, [], 0

        def best_of(parts):
            owner, worse, ids = (np.concatenate(c) for c in zip(*parts, strict=True))
            order = np.lexsort((ids, worse, owner))
            owner, worse, ids = owner[order], worse[order], ids[order]
            new = np.ones(len(owner), dtype=bool)
            new[1:] = (owner[1:] != owner[:-1]) | (worse[1:] != worse[:-1]) | (ids[1:] != ids[:-1])
            owner, worse, ids = owner[new], worse[new], ids[new]
            stay = _ranks(owner) < keep
            return owner[stay], worse[stay], ids[stay]

        for batch in batches:
            found = batch.column(batch.schema.get_field_index("found"))
            own = np.array([places.setdefault(n, len(places)) for n in batch.column(batch.schema.get_field_index("name")).to_pylist()], dtype=np.int64)
            flat = found.flatten()
            held.append((np.repeat(own, np.diff(found.offsets.to_numpy())), flat.field("worse").to_numpy(), flat.field("id").to_numpy()))
            waiting += len(flat)
            if waiting > flush:
                held, waiting = [best_of(held)], 0
        if held:
            names, found = _listed(pa.array(list(places), pa.binary()), *best_of(held))
            yield pa.RecordBatch.from_arrays([names, found], names=["name", "found"])

    return run
