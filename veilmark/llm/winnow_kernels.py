"""Arrow kernels of benchmark decontamination."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from . import textscan as ts


def _window_minima(hashes, width):
    n = len(hashes) - width + 1
    if n <= 0:
        return hashes[:0]
    low = hashes[:n].copy()
    for t in range(1, width):
        np.minimum(low, hashes[t : t + n], out=low)
    return low


def build_index(items, p):
    """Fingerprints of the long items, window hash -> item ids by window length, and the sorted window hashes."""
    prints, windows = [], {}
    for item, text in items:
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        starts, ends, _ = ts.words(data, np.array([0, len(data)]), ts.ALNUM)
        hashes = ts.word_hashes(data, starts, ends)
        size = min(len(hashes), p.window_words)
        if not size:
            continue
        if size == p.window_words:
            prints.append(_window_minima(ts.grams(hashes, p.gram_words), size - p.gram_words + 1))
        for h in set(ts.grams(hashes, size).tolist()):
            windows.setdefault(size, {}).setdefault(h, set()).add(item)
    sorted_windows = {size: np.array(sorted(found), dtype=np.uint64) for size, found in windows.items()}
    prints = np.unique(np.concatenate(prints)) if prints else np.zeros(0, dtype=np.uint64)
    return prints, windows, sorted_windows


def _member(values, ordered, filter_bits):
    """Positions of values that are in ordered; filter_bits is a bit table that most others miss."""
    maybe = np.flatnonzero(filter_bits[(values & np.uint64(len(filter_bits) - 1)).astype(np.int64)])
    if not len(maybe):
        return maybe
    at = np.searchsorted(ordered, values[maybe])
    at[at == len(ordered)] = 0
    return maybe[ordered[at] == values[maybe]]


def _bits(ordered):
    bits = np.zeros(1 << max(16, int(len(ordered) * 8).bit_length()), dtype=bool)
    bits[(ordered & np.uint64(len(bits) - 1)).astype(np.int64)] = True
    return bits


def scanner(index, p):
    def run(batches):
        prints, windows, ordered = index.value
        print_bits, window_bits = _bits(prints), {size: _bits(found) for size, found in ordered.items()}
        for batch in batches:
            n_words, spans, items = np.zeros(batch.num_rows, np.int64), [[] for _ in range(batch.num_rows)], [[] for _ in range(batch.num_rows)]
            for first, last, data, offsets in ts.pieces(batch):
                starts, ends, rows = ts.words(data, offsets, ts.ALNUM)
                bounds = ts.row_bounds(rows, last - first)
                n_words[first:last] = np.diff(bounds)
                hashes = ts.word_hashes(data, starts, ends)
                cover, found = np.zeros(len(hashes) + 1, dtype=np.int32), {}
                for size, sorted_hashes in ordered.items():
                    if len(hashes) < size:
                        continue
                    if size == p.window_words:
                        low = _window_minima(ts.grams(hashes, p.gram_words), size - p.gram_words + 1)
                        at = _member(low, prints, print_bits)
                        at = at[rows[at] == rows[at + size - 1]]
                        whole = np.zeros(0, dtype=np.uint64)
                        if len(at):  # extend each hit over its window
                            whole = ts.mix(hashes[at] + np.uint64(size))
                            for t in range(1, size):
                                whole = ts.mix(whole * np.uint64(0x2545F4914F6CDD1D) + hashes[at + t])
                        hit = _member(whole, sorted_hashes, window_bits[size])
                        at, whole = at[hit], whole[hit]
                    else:
                        every = ts.grams(hashes, size)
                        at = _member(every, sorted_hashes, window_bits[size])
                        at = at[rows[at] == rows[at + size - 1]]
                        whole = every[at]
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + size, -1)
                    for row, h in set(zip(rows[at].tolist(), whole.tolist(), strict=True)):
                        found.setdefault(row, set()).update(windows[size][h])
                if found:
                    inside = np.cumsum(cover)[:-1] > 0
                    for row, got in found.items():
                        own = np.concatenate(([False], inside[bounds[row] : bounds[row + 1]], [False]))
                        edges = np.flatnonzero(own[1:] != own[:-1])
                        spans[first + row] = [{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)]
                        items[first + row] = sorted(got)
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words), pa.array(spans, span), pa.array(items, pa.list_(pa.string()))], names=[batch.schema.names[0], "n_words", "spans", "items"])

    return run
