"""Arrow kernels of the toxicity operator."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from . import textscan as ts


def _slots(data, offsets, p):
    """Slot and row of every word and of the first bytes of every longer word, ordered by row."""
    starts, ends, rows = ts.words(data, offsets, ts.ALNUM)
    slots, owners = [ts.word_hashes(data, starts, ends)], [rows]
    for size in p.prefixes:
        longer = np.flatnonzero(ends - starts > size)
        slots.append(ts.mix(ts.word_hashes(data, starts[longer], starts[longer] + size) + np.uint64(size)))
        owners.append(rows[longer])
    slots, owners = (np.concatenate(slots) % np.uint64(p.slots)).astype(np.int32), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return slots[order], owners[order]


def word_slots(p, categories):
    def run(batches):
        for batch in batches:
            found = []
            for first, last, data, offsets in ts.pieces(batch):
                slots, rows = _slots(data, offsets, p)
                bounds = ts.row_bounds(rows, last - first)
                found += [np.unique(slots[bounds[i] : bounds[i + 1]]).tobytes() for i in range(last - first)]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in categories], pa.array(found, pa.binary())], names=[*categories, "at"])

    return run


def predictor(links, p, categories):
    def run(batches):
        tables = []
        for used, weights, intercept, earlier in links.value:
            table = np.zeros(p.slots)
            table[used] = weights
            tables.append((table, intercept, earlier))
        relevant = np.any([table != 0 for table, _, _ in tables], axis=0)
        for batch in batches:
            shares = np.zeros((batch.num_rows, len(tables)))
            has_words = np.zeros(batch.num_rows, dtype=bool)
            for first, last, data, offsets in ts.pieces(batch):
                slots, rows = _slots(data, offsets, p)
                has_words[first:last] = np.bincount(rows, minlength=last - first) > 0
                kept = relevant[slots]
                pairs = np.unique(rows[kept].astype(np.int64) * p.slots + slots[kept])  # a word counts once in a text
                rows, slots = pairs // p.slots, pairs % p.slots
                for k, (table, intercept, earlier) in enumerate(tables):
                    logit = intercept + np.bincount(rows, weights=table[slots], minlength=last - first)
                    for e, w in enumerate(earlier):
                        logit = logit + w * shares[first:last, e]
                    shares[first:last, k] = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
            flagged = has_words & (shares[:, -1] >= p.threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(flagged), *[pa.array(shares[:, k]) for k in range(len(tables))]], names=["doc_id", "flagged", *[f"p_{c}" for c in categories]])

    return run
