"""Arrow kernels of the near-duplicate operator."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from . import textscan as ts


def _sets(batch, p, column="text"):
    """(row, sorted distinct shingle hashes) of every row."""
    for first, last, data, offsets in ts.pieces(batch, column):
        starts, ends, rows = ts.words(data, offsets, ts.NOT_SPACE)
        hashes = ts.word_hashes(data, starts, ends)
        for row, found in ts.row_shingles(hashes, ts.row_bounds(rows, last - first), p.shingle_words):
            yield first + row, found


def signature(found, p):
    """The values of a set's signature: the first bits of a hash name its coordinate, which keeps its least hash."""
    at = found >> np.uint64(64 - p.coordinate_bits)
    new = np.ones(len(at), dtype=bool)
    new[1:] = at[1:] != at[:-1]
    return found[new]


def _class_of(found):
    """A 64-bit name of a set; 0 of the empty one."""
    if not len(found):
        return 0
    name = ts.mix(found.sum(dtype=np.uint64, keepdims=True) ^ ts.mix(ts.mix(found).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(found))))
    return int(name.view(np.int64)[0]) or 1


def signer(p):
    """The columns of docs, then class and n_shingles of the text."""

    def run(batches):
        for batch in batches:
            sizes, names = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for row, found in _sets(batch, p):
                sizes[row], names[row] = len(found), _class_of(found)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names), pa.array(sizes)], names=[*batch.schema.names, "class", "n_shingles"])

    return run


def class_texts(p):
    """(class, text) of each class once a task."""

    def run(batches):
        seen = set()
        for batch in batches:
            names, keep = [], []
            for row, found in _sets(batch, p):
                name = _class_of(found)
                if name and name not in seen:
                    seen.add(name)
                    names.append(name)
                    keep.append(row)
            if keep:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), batch.column(batch.schema.get_field_index("text")).take(pa.array(keep))], names=["class", "text"])

    return run


def slot_counter(p, block):
    def run(batches):
        counts = np.zeros(p.order_slots, dtype=np.uint64)
        any_row = False
        for batch in batches:
            for _, found in _sets(batch, p):
                any_row = True
                np.add.at(counts, (signature(found, p) % np.uint64(p.order_slots)).astype(np.int64), np.uint64(1))
        if any_row:
            for b in range(p.order_slots // block):
                part = counts[b * block : (b + 1) * block]
                if part.any():
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["block", "counts"])

    return run


def slot_summer(block):
    def run(batches):
        sums = {}
        for batch in batches:
            for b, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[b] = sums.get(b, 0) + np.frombuffer(counts, dtype=np.uint64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["block", "counts"])

    return run


POSTING = "value long, class long, n int, at int, share float"


def poster(p, order):
    """POSTING: the prefix of each class's signature, rarest values first, once a task."""

    def run(batches):
        levels, seen = np.frombuffer(order.value, dtype=np.uint8), set()
        for batch in batches:
            parts = []
            for _, found in _sets(batch, p):
                name = _class_of(found)
                if not name or name in seen:
                    continue
                seen.add(name)
                values = signature(found, p)
                n, share = len(values), p.match_share(len(found), len(values))
                keep = n - int(np.ceil(share * n - 1e-9)) + 1
                rank = levels[(values % np.uint64(p.order_slots)).astype(np.int64)]
                first = values[np.argsort(rank, kind="stable")[:keep]]  # equal ranks stay in hash order
                k = len(first)
                parts.append((first.view(np.int64), np.full(k, name), np.full(k, n, np.int32), np.arange(k, dtype=np.int32), np.full(k, share, np.float32)))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], names=["value", "class", "n", "at", "share"])

    return run


def confirmer(p):
    """The pairs (a, b) whose signatures collide often enough and whose full sets are similar enough."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                good = []
                for (_, x), (_, y) in zip(_sets(part, p, "ta"), _sets(part, p, "tb"), strict=True):
                    u, v = signature(x, p), signature(y, p)
                    hits = len(np.intersect1d(u, v, assume_unique=True))
                    share = min(p.match_share(len(x), len(u)), p.match_share(len(y), len(v)))
                    ok = hits >= share * (len(u) + len(v) - hits) - 1e-9
                    if ok:
                        both = len(np.intersect1d(x, y, assume_unique=True))
                        ok = both > 0 and p.den * both >= p.num * (len(x) + len(y) - both)
                    good.append(ok)
                yield part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run
