"""Arrow kernels of language identification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from . import linear
from . import textscan as ts


def _gram_slots(data, offsets, p):
    """For each gram length: (slot of each gram, row of each gram)."""
    if not len(data):
        return
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    lead = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    bounds = lead[offsets]
    upper = ((points >= 65) & (points <= 90)) | ((points >= 0xC0) & (points <= 0xDE) & (points != 0xD7))
    points = (points + 32 * upper).astype(np.uint64)
    rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    shift = np.uint64(64 - int(p.slots).bit_length() + 1)
    for size in (1, 2, 3):
        n = len(points) - size + 1
        if n <= 0:
            return
        code = points[:n] + np.uint64(size << 32)
        for t in range(1, size):
            code = code * np.uint64(0x100000001B3) + points[t : t + n]
        own = rows[:n] == rows[size - 1 :]
        slot = ((code * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int32)
        yield slot[own], rows[:n][own]


def document_frequency(p):
    def run(batches):
        df, texts = np.zeros(p.slots, dtype=np.int64), 0
        for batch in batches:
            for first, last, data, offsets in ts.pieces(batch):
                texts += last - first
                for a in range(0, last - first, 256):  # a flag for each text and slot
                    b = min(a + 256, last - first)
                    seen = np.zeros((b - a) * p.slots, dtype=bool)
                    for slot, row in _gram_slots(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], p):
                        seen[row * p.slots + slot] = True
                    df += seen.reshape(b - a, p.slots).sum(axis=0)
        at = np.flatnonzero(df)
        if texts:
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, p.slots).astype(np.int32)), pa.array(np.append(df[at], texts))], names=["slot", "n"])

    return run


def gram_counts(p):
    def run(batches):
        for batch in batches:
            at, n = [], []
            for first, last, data, offsets in ts.pieces(batch):
                for row in range(last - first):
                    counts = np.zeros(p.slots, dtype=np.int64)
                    for slot, _ in _gram_slots(data[offsets[row] : offsets[row + 1]], np.array([0, offsets[row + 1] - offsets[row]]), p):
                        counts += np.bincount(slot, minlength=p.slots)
                    found = np.flatnonzero(counts)
                    at.append(found.astype(np.int32).tobytes())
                    n.append(counts[found].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(at, pa.binary()), pa.array(n, pa.binary())], names=["lang", "at", "n"])

    return run


def predictor(table, p):
    def run(batches):
        names, weights = table.value
        for batch in batches:
            has_letter = batch.column(batch.num_columns - 2).to_numpy(zero_copy_only=False).astype(bool)
            logits, grams = np.zeros((batch.num_rows, weights.shape[1])), np.zeros(batch.num_rows)
            columns = [np.ascontiguousarray(weights[:, c]) for c in range(weights.shape[1])]
            for first, last, data, offsets in ts.pieces(batch):
                for slot, row in _gram_slots(data, offsets, p):
                    grams[first:last] += np.bincount(row, minlength=last - first)
                    for c, column in enumerate(columns):
                        logits[first:last, c] += np.bincount(row, weights=column[slot], minlength=last - first)
            share = linear.softmax(logits / np.maximum(grams, 1)[:, None])
            best = share.argmax(axis=1)
            known = has_letter & bool(names)
            pred = [names[b] if ok else "und" for b, ok in zip(best, known, strict=True)]
            score = np.where(known, share[np.arange(len(best)), best], 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(pred, pa.string()), pa.array(score)], names=[*batch.schema.names[:-2], "lang_pred", "score"])

    return run
