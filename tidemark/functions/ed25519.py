"""Ed25519 signatures (RFC 8032) of canonical heads, as a batched function over columns."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

P = 2**255 - 19
L = 2**252 + 27742317777372353535851937790883648493
D = -121665 * pow(121666, -1, P) % P
ROOT = pow(2, (P - 1) // 4, P)


def _x(y: int, sign: int) -> int | None:
    """The x of a point with a given y and sign bit, if there is one."""
    if y >= P:
        return None
    square = (y * y - 1) * pow(D * y * y + 1, -1, P) % P
    x = pow(square, (P + 3) // 8, P)
    if x * x % P != square:
        x = x * ROOT % P
    if x * x % P != square or x == 0 and sign:
        return None
    return P - x if x % 2 != sign else x


def _point(x: int, y: int) -> tuple[int, int, int, int]:
    return x, y, 1, x * y % P


BASE = _point(_x(4 * pow(5, -1, P) % P, 0), 4 * pow(5, -1, P) % P)


def _add(p: tuple, q: tuple) -> tuple[int, int, int, int]:
    a, b = (p[1] - p[0]) * (q[1] - q[0]) % P, (p[1] + p[0]) * (q[1] + q[0]) % P
    c, d = 2 * p[3] * q[3] * D % P, 2 * p[2] * q[2] % P
    e, f, g, h = b - a, d - c, d + c, b + a
    return e * f % P, g * h % P, f * g % P, e * h % P


def _times(n: int, p: tuple) -> tuple[int, int, int, int]:
    out = (0, 1, 1, 0)
    while n:
        if n & 1:
            out = _add(out, p)
        p, n = _add(p, p), n >> 1
    return out


def _pack(p: tuple) -> bytes:
    z = pow(p[2], -1, P)
    x, y = p[0] * z % P, p[1] * z % P
    return (y | (x & 1) << 255).to_bytes(32, "little")


def _unpack(raw: bytes) -> tuple | None:
    n = int.from_bytes(raw, "little")
    y = n & (1 << 255) - 1
    x = _x(y, n >> 255)
    return None if x is None else _point(x, y)


def _number(*parts: bytes) -> int:
    return int.from_bytes(hashlib.sha512(b"".join(parts)).digest(), "little")


def _secret(seed: bytes) -> tuple[int, bytes]:
    h = hashlib.sha512(seed).digest()
    a = int.from_bytes(h[:32], "little") & (1 << 254) - 8 | 1 << 254
    return a, h[32:]


def public_key(seed: bytes) -> bytes:
    return _pack(_times(_secret(seed)[0], BASE))


#: RFC 8032, section 2: what goes before the hash of a prehashed message without context.
PREHASHED = b"SigEd25519 no Ed25519 collisions" + bytes([1, 0])


def sign(seed: bytes, message: bytes, prehashed: bool = False) -> bytes:
    a, prefix = _secret(seed)
    key = public_key(seed)
    front = PREHASHED if prehashed else b""
    body = hashlib.sha512(message).digest() if prehashed else message
    r = _number(front, prefix, body) % L
    point = _pack(_times(r, BASE))
    s = (r + _number(front, point, key, body) * a) % L
    return point + s.to_bytes(32, "little")


def verify(key: bytes, message: bytes, signature: bytes, prehashed: bool = False) -> bool:
    if len(key) != 32 or len(signature) != 64:
        return False
    a, r, s = _unpack(key), _unpack(signature[:32]), int.from_bytes(signature[32:], "little")
    if a is None or r is None or s >= L:
        return False
    front = PREHASHED if prehashed else b""
    body = hashlib.sha512(message).digest() if prehashed else message
    k = _number(front, signature[:32], key, body) % L
    return _pack(_times(s, BASE)) == _pack(_add(r, _times(k, a)))


@F.pandas_udf(T.BooleanType())
def verified(key: pd.Series, message: pd.Series, signature: pd.Series) -> pd.Series:
    """Whether hex signatures of messages are by hex keys; false for what isn't lower-case hex."""

    def one(k: str | None, m: str | None, s: str | None) -> bool:
        try:
            return k == k.lower() and s == s.lower() and verify(bytes.fromhex(k), m.encode(), bytes.fromhex(s))
        except (AttributeError, ValueError):
            return False

    return pd.Series([one(*x) for x in zip(key, message, signature, strict=True)], dtype=bool)
