"""The BLAKE3 hash of the published specification, for which Spark and Python have no built-in."""

from __future__ import annotations

import struct

# Fixed values of the specification: the initial state and the order of message words.
_IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
_ORDER = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
_START, _END, _PARENT, _ROOT = 1, 2, 4, 8
_CHUNK, _BLOCK, _MASK = 1024, 64, 0xFFFFFFFF
#: Columns, then diagonals of the state as a square.
_STEPS = [(i, 4 + i, 8 + i, 12 + i) for i in range(4)] + [(i, 4 + (i + 1) % 4, 8 + (i + 2) % 4, 12 + (i + 3) % 4) for i in range(4)]


def _turn(x: int, n: int) -> int:
    return (x >> n) | (x << (32 - n)) & _MASK


def _compress(chain: tuple[int, ...], block: bytes, counter: int, flags: int) -> tuple[int, ...]:
    m = list(struct.unpack("<16I", block.ljust(_BLOCK, b"\0")))
    v = [*chain, *_IV[:4], counter & _MASK, counter >> 32, len(block), flags]
    for _ in range(7):
        for k, (a, b, c, d) in enumerate(_STEPS):
            for x, r, q in ((m[2 * k], 16, 12), (m[2 * k + 1], 8, 7)):
                v[a] = (v[a] + v[b] + x) & _MASK
                v[d] = _turn(v[d] ^ v[a], r)
                v[c] = (v[c] + v[d]) & _MASK
                v[b] = _turn(v[b] ^ v[c], q)
        m = [m[i] for i in _ORDER]
    return tuple(v[i] ^ v[i + 8] for i in range(8))


def _chunk(data: bytes, counter: int, root: int) -> tuple[int, ...]:
    chain, last = _IV, max(0, (len(data) - 1) // _BLOCK)
    for i in range(last + 1):
        flags = (_START if i == 0 else 0) | ((_END | root) if i == last else 0)
        chain = _compress(chain, data[i * _BLOCK : (i + 1) * _BLOCK], counter, flags)
    return chain


def _tree(data: bytes, counter: int, root: int) -> tuple[int, ...]:
    if len(data) <= _CHUNK:
        return _chunk(data, counter, root)
    # the left subtree is the greatest power of two of chunks that leaves something to the right
    left = 1 << ((len(data) - 1) // _CHUNK).bit_length() - 1
    one, two = _tree(data[: left * _CHUNK], counter, 0), _tree(data[left * _CHUNK :], counter + left, 0)
    return _compress(_IV, struct.pack("<16I", *one, *two), 0, _PARENT | root)


def blake3(data: bytes) -> bytes:
    """The 32 bytes of the unkeyed hash."""
    return struct.pack("<8I", *_tree(bytes(data), 0, _ROOT))
