"""Arrow kernels of the Merkle manifest: blocks of consecutive nodes are reduced and their proofs written out."""

from __future__ import annotations

import hashlib
from itertools import groupby

import pyarrow as pa


def h(parts) -> str:
    """Lowercase hex SHA-256 of concatenated hex texts."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def reduce_nodes(nodes, fan_out, levels=None):
    """All levels of a tree over the nodes, each run of fan_out (the last may be shorter) hashed to one;
    up to one node, or exactly so many levels."""
    every = [nodes]
    while len(every) - 1 < levels if levels is not None else len(every[-1]) > 1:
        last = every[-1]
        every.append([h(last[at : at + fan_out]) for at in range(0, len(last), fan_out)])
    return every


def path(every, at, fan_out):
    """(siblings left of the node, siblings right of it) on each level."""
    out = []
    for level in every[:-1]:
        first = at - at % fan_out
        out.append((level[first:at], level[at + 1 : first + fan_out]))
        at //= fan_out
    return out


def fold(leaf, steps):
    for left, right in steps:
        leaf = h([*left, leaf, *right])
    return leaf


def _levels(alone, p):
    return None if alone else p.block_levels


def _blocks(batches):
    """Runs of consecutive rows of one block, over the borders of batches."""
    rows = (row for batch in batches for row in batch.to_pylist())
    for _, block in groupby(rows, key=lambda r: (r["grp"], r["block"])):
        yield list(block)


def tops(p):
    """grp, block, hash of each block's top node."""

    def run(batches):
        for block in _blocks(batches):
            top = reduce_nodes([r["hash"] for r in block], p.fan_out, _levels(block[0]["alone"], p))[-1][0]
            yield pa.RecordBatch.from_pylist([{"grp": block[0]["grp"], "block": block[0]["block"], "hash": top}], schema=TOPS)

    return run


TOPS = pa.schema([("grp", pa.int64()), ("block", pa.int64()), ("hash", pa.string())])
_STEPS = pa.list_(pa.struct([("left", pa.list_(pa.string())), ("right", pa.list_(pa.string()))]))
STEPS = "array<struct<left:array<string>,right:array<string>>>"


def _pairs(steps):
    return [{"left": a, "right": b} for a, b in steps]


def suffixes(p):
    """grp, block, steps, subroot, root of the blocks below, which are the members of these blocks."""
    schema = pa.schema([("grp", pa.int64()), ("block", pa.int64()), ("steps", _STEPS), ("subroot", pa.string()), ("root", pa.string())])

    def run(batches):
        for block in _blocks(batches):
            first = block[0]
            every = reduce_nodes([r["hash"] for r in block], p.fan_out, _levels(first["alone"], p))
            rest = first["steps"]
            out = []
            for at, r in enumerate(block):
                # a member that is the root of its own group is the group's subroot
                out.append({"grp": r["below_grp"], "block": r["below_block"], "steps": _pairs(path(every, at, p.fan_out)) + rest, "subroot": r["hash"] if first["crossed"] else first["subroot"], "root": first["root"]})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def proofs(p, key):
    """The row's key columns, leaf, subroot, root, proof (siblings in order) and the root folded from what the row holds now."""
    out_schema = pa.schema([*key, ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("proof", pa.list_(pa.string())), ("folded_root", pa.string())])
    names = [f.name for f in key]

    def run(batches):
        for block in _blocks(batches):
            first = block[0]
            every = reduce_nodes([r["hash"] for r in block], p.fan_out, _levels(first["alone"], p))
            rest = [(s["left"], s["right"]) for s in first["steps"]]
            out = []
            for at, r in enumerate(block):
                steps = path(every, at, p.fan_out) + rest
                folded = first["root"] if r["now"] == r["hash"] and not p.refold else fold(r["now"], steps)
                out.append({n: r[n] for n in names} | {"leaf": r["hash"], "subroot": first["subroot"], "root": first["root"], "proof": [x for s in steps for side in s for x in side], "folded_root": folded})
            yield pa.RecordBatch.from_pylist(out, schema=out_schema)

    return run


def finish(nodes, crossed, fan_out):
    """The top tree over nodes (grp, pos, hash), sorted: (grp, pos, steps, subroot, root) of each.

    Uncrossed nodes form a tree for each group, whose roots form the last one; crossed ones are group roots already.
    """
    if not nodes:
        return []
    groups = [list(part) for _, part in groupby(nodes, key=lambda n: n[0])]
    trees = [reduce_nodes([n[2] for n in g], fan_out) for g in groups]
    subroots = [t[-1][0] for t in trees]
    last = reduce_nodes(subroots, fan_out)
    root = last[-1][0]
    out = []
    for i, (g, t) in enumerate(zip(groups, trees, strict=True)):
        above = path(last, i, fan_out)
        for at, (grp, pos, _) in enumerate(g):
            out.append((grp, pos, _pairs(path(t, at, fan_out) + above), None if crossed else subroots[i], root))
    return out
