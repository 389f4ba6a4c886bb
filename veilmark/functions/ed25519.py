"""Ed25519 signatures (RFC 8032) for the few bytes of a document's digest text; a helper of tasks, no bulk cipher."""

from __future__ import annotations

import hashlib
from functools import lru_cache

# The field, the curve constant, the group order and the base point's y = 4/5.
P = 2**255 - 19
D = -121665 * pow(121666, -1, P) % P
ORDER = 2**252 + 27742317777372353535851937790883648493
_ROOT = pow(2, (P - 1) // 4, P)

Point = tuple[int, int, int, int]  # x z, y z, z, x y z


def _add(a: Point, b: Point) -> Point:
    e, f = (a[1] - a[0]) * (b[1] - b[0]) % P, (a[1] + a[0]) * (b[1] + b[0]) % P
    g, h = 2 * a[3] * b[3] * D % P, 2 * a[2] * b[2] % P
    w, x, y, z = f - e, h - g, h + g, f + e
    return w * x % P, y * z % P, x * y % P, w * z % P


def _decode(data: bytes) -> Point | None:
    """The point of 32 bytes, or None where they encode none."""
    y = int.from_bytes(data, "little")
    odd, y = y >> 255, y & ((1 << 255) - 1)
    if len(data) != 32 or y >= P:
        return None
    square = (y * y - 1) * pow(D * y * y + 1, -1, P) % P
    x = pow(square, (P + 3) // 8, P)
    if (x * x - square) % P:
        x = x * _ROOT % P
    if (x * x - square) % P or (x == 0 and odd):
        return None
    x = P - x if x & 1 != odd else x
    return x, y, 1, x * y % P


def _encode(point: Point) -> bytes:
    inverse = pow(point[2], -1, P)
    x, y = point[0] * inverse % P, point[1] * inverse % P
    return (y | (x & 1) << 255).to_bytes(32, "little")


_BASE = (4 * pow(5, -1, P) % P).to_bytes(32, "little")


@lru_cache(maxsize=16)
def _multiples(point: bytes) -> list[list[Point]]:
    """Of a point that many products share, its multiples by 0 to 15 times each power of 16."""
    step, table = _decode(point), []
    for _ in range(64):
        row: list[Point] = [(0, 1, 1, 0)]
        for _ in range(15):
            row.append(_add(row[-1], step))
        table.append(row)
        step = _add(row[-1], step)
    return table


def _times_known(n: int, point: bytes) -> Point:
    """n below 2^256 times an encoded point."""
    total: Point = (0, 1, 1, 0)
    for row in _multiples(point):
        if n & 15:
            total = _add(total, row[n & 15])
        n >>= 4
    return total


def _number(*parts: bytes) -> int:
    return int.from_bytes(hashlib.sha512(b"".join(parts)).digest(), "little") % ORDER


def _secret(seed: bytes) -> tuple[int, bytes]:
    digest = hashlib.sha512(seed).digest()
    number = int.from_bytes(digest[:32], "little")
    return number & ((1 << 254) - 8) | 1 << 254, digest[32:]


@lru_cache(maxsize=16)
def _decoded_key(key: bytes) -> Point | None:
    return _decode(key)


@lru_cache(maxsize=16)
def public_key(seed: bytes) -> bytes:
    return _encode(_times_known(_secret(seed)[0], _BASE))


def sign(seed: bytes, message: bytes) -> bytes:
    number, prefix = _secret(seed)
    nonce = _number(prefix, message)
    start = _encode(_times_known(nonce, _BASE))
    return start + ((nonce + _number(start, public_key(seed), message) * number) % ORDER).to_bytes(32, "little")


def verify(key: bytes, message: bytes, signature: bytes) -> bool:
    """Whether the signature is of this message under this key; false for keys and signatures that are no such bytes."""
    owner, start = _decoded_key(key), _decode(signature[:32])
    number = int.from_bytes(signature[32:], "little")
    if len(signature) != 64 or owner is None or start is None or number >= ORDER:
        return False
    left, right = _times_known(number, _BASE), _add(start, _times_known(_number(signature[:32], key, message), key))
    return (left[0] * right[2] - right[0] * left[2]) % P == 0 and (left[1] * right[2] - right[1] * left[2]) % P == 0
