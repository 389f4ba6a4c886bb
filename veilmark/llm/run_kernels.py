"""Arrow kernels of periodic run detection: suffix automata whose end-position sets are merged small to large."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa

from . import textscan as ts


class Ends:
    """An ordered set of positions in short sorted chunks, so that an insertion never moves much."""

    CHUNK = 512

    def __init__(self, at):
        self.size, self.chunks, self.last = 1, [[at]], [at]

    def __iter__(self):
        for chunk in self.chunks:
            yield from chunk

    def add(self, x):
        """Puts x in; its neighbours before and after, or None."""
        chunks, last = self.chunks, self.last
        c = bisect_left(last, x)
        self.size += 1
        if c == len(last):  # beyond all
            before, chunk = last[-1], chunks[-1]
            chunk.append(x)
            last[-1] = x
            if len(chunk) > self.CHUNK:
                self._split(c - 1)
            return before, None
        chunk = chunks[c]
        at = bisect_left(chunk, x)
        before = chunk[at - 1] if at else last[c - 1] if c else None
        after = chunk[at]
        chunk.insert(at, x)
        if len(chunk) > self.CHUNK:
            self._split(c)
        return before, after

    def _split(self, c):
        chunk = self.chunks[c]
        half = len(chunk) // 2
        self.chunks[c : c + 1] = [chunk[:half], chunk[half:]]
        self.last[c : c + 1] = [chunk[half - 1], chunk[-1]]


def automaton(ids):
    """(longest length, suffix link, end position or -1 of clones) of the states of the words' suffix automaton; state 0 is the root."""
    length, link, end, moves = [0], [-1], [-1], [{}]
    last = 0
    for i, w in enumerate(ids):
        new = len(length)
        length.append(i + 1)
        link.append(0)
        end.append(i)
        moves.append({})
        p = last
        while p >= 0 and w not in moves[p]:
            moves[p][w] = new
            p = link[p]
        if p >= 0:
            q = moves[p][w]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                clone = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                end.append(-1)
                moves.append(moves[q].copy())
                while p >= 0 and moves[p].get(w) == q:
                    moves[p][w] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return length, link, end


def find_runs(ids, least, times):
    """{(start, end): period} of the maximal stretches with a smallest period, at least ``least`` long and ``times`` periods long.

    Two ends that first meet in a state have exactly that state's words in common to their left.  Where their distance is no
    longer than that, these words and the distance make a stretch with that period that cannot grow to the left, a seed that holds a square;
    extended to the right it is a run.  All seeds of a run but the one at its end grow there, so only that one is kept.
    """
    n, (length, link, end) = len(ids), automaton(ids)
    sets = [Ends(e) if e >= 0 else None for e in end]
    runs = {}
    for state in np.argsort(np.array(length), kind="stable")[:0:-1].tolist():
        up = link[state]
        if up <= 0:
            sets[state] = None
            continue
        small, big, common = sets[state], sets[up], length[up]
        sets[state] = None
        if big is None:
            sets[up] = small
            continue
        if small.size > big.size:
            small, big = big, small
        fresh = None  # an element of the smaller set met its neighbours there deeper down
        for x in small:
            before, after = big.add(x)
            for i, j in ((before, x), (x, after)):
                if i is None or j is None or i == fresh or j - i > common:
                    continue
                size = common + j - i
                if size < least or size < times * (j - i) or (j + 1 < n and ids[i + 1] == ids[j + 1]):
                    continue
                where = (i - common + 1, j + 1)
                runs[where] = min(runs.get(where, size), j - i)
            fresh = x
        sets[up] = big
    return runs


def recurring(hashes, starts, width):
    """Which words lie in a stretch of ``width`` words that occurs twice or more in their text; starts: each text's first word, and the end."""
    n = len(hashes)
    inside = np.zeros(n, dtype=bool)
    if n < width:
        return inside
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    grams = hashes
    size = 1
    while size < width:  # width is a power of two
        grams = ts.mix(grams[: len(grams) - size] * np.uint64(0x9E3779B97F4A7C15) + grams[size:] + np.uint64(size))
        size *= 2
    whole = np.flatnonzero(row[: len(grams)] == row[width - 1 :])
    keys = ts.mix(grams[whole] + row[whole].astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9))
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(whole), dtype=bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    cover = np.zeros(n + 1, dtype=np.int64)
    cover[whole[twice]] += 1
    cover[whole[twice] + width] -= 1
    return np.cumsum(cover)[:-1] > 0


def stretches(mask):
    """(first, end) of each run of true values."""
    padded = np.concatenate(([False], mask, [False]))
    edges = np.flatnonzero(padded[1:] != padded[:-1])
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def runs_of(words, inside, p):
    """Sorted (start, length, period) of the runs of a text whose candidates are marked."""
    found = []
    for first, end in stretches(inside):
        if end - first < p.least_words:
            continue
        ids = {}
        part = find_runs([ids.setdefault(w, len(ids)) for w in words[first:end]], p.least_words, p.least_periods)
        found += [(first + a, b - a, q) for (a, b), q in part.items()]
    return sorted(found)


RUNS = "array<struct<start:long,length:long,period:long>>"


def finder(p):
    """The columns before text, n_words, runs, and the text with each run's repetitions left out, words joined by one space."""

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            out = []
            at = 0
            while at < len(texts):  # whole texts up to some size at once
                part, size = [], 0
                while at < len(texts) and (not part or size < ts.PIECE_BYTES):
                    part.append((texts[at] or "").encode().split())
                    size += len(texts[at] or "")
                    at += 1
                starts = np.cumsum([0, *map(len, part)])
                hashes = np.fromiter((hash(w) for words in part for w in words), np.int64, int(starts[-1])).view(np.uint64)
                inside = recurring(hashes, starts, p.gram_words)
                for k, words in enumerate(part):
                    mine = inside[starts[k] : starts[k + 1]]
                    runs = runs_of(words, mine, p) if mine.any() else []
                    gone = np.zeros(len(words) + 1, dtype=np.int64)
                    for first, length, period in runs:
                        gone[first + period] += 1
                        gone[first + length] -= 1
                    kept = words if not runs else [w for w, g in zip(words, np.cumsum(gone).tolist(), strict=False) if not g]
                    out.append((len(words), [{"start": a, "length": b, "period": q} for a, b, q in runs], b" ".join(kept).decode()))
            keys = [batch.column(i) for i in range(batch.num_columns - 1)]
            n, runs, rest = zip(*out, strict=True) if out else ((), (), ())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*keys, pa.array(n, pa.int64()), pa.array(runs, kind), pa.array(rest, pa.string())], names=[*batch.schema.names[:-1], "n_words", "runs", "collapsed"])

    return run
