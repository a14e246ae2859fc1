"""Numbers in binary columns, as planes of bytes, and a mixing function."""

from __future__ import annotations

import numpy as np

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def mixed(x: np.ndarray, k: int) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers; ``k`` chooses one of six."""
    x = (x ^ (x >> np.uint64(32))) * _MIX[k]
    return x ^ (x >> np.uint64(29))


def packed(keys: np.ndarray, wide: int = 6) -> bytes:
    """Numbers as planes of their lower bytes: keys are sorted and counts mostly small, so that the upper planes compress."""
    return np.ascontiguousarray(keys).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide].T.tobytes()


def unpacked(data: bytes, wide: int = 6) -> np.ndarray:
    out = np.zeros((len(data) // wide, 8), np.uint8)
    out[:, :wide] = np.frombuffer(data, np.uint8).reshape(wide, -1).T
    return out.view("<u8").ravel()


def counts(a: np.ndarray) -> bytes:
    """Numbers from zero up in as many planes as the largest needs."""
    return packed(a, max(1, -(-int(a.max(initial=0)).bit_length() // 8)))


def uncounted(data: bytes, n: int) -> np.ndarray:
    """``n`` numbers written by :func:`counts`."""
    return unpacked(data, max(1, len(data) // max(n, 1))).astype(np.int64)
