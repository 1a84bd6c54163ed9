"""Hashed byte n-gram counts, by numpy over whole texts."""

from __future__ import annotations

import numpy as np

_SPACE = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def trigram_bins(text: str, bits: int, letters_only: bool = True) -> np.ndarray:
    """The bin of each byte trigram of the lower-cased text whose middle byte isn't a space.

    With ``letters_only`` all other ASCII counts as space.
    """
    raw = b" " + text.lower().encode("utf-8", "replace") + b" "
    b = np.frombuffer(raw.translate(_SPACE) if letters_only else raw, dtype=np.uint8)
    if len(b) < 3:
        return np.empty(0, dtype=np.uint32)
    code = b[:-2].astype(np.uint32)
    code |= b[1:-1].astype(np.uint32) << np.uint32(8)
    code |= b[2:].astype(np.uint32) << np.uint32(16)
    code = code[b[1:-1] > 32]
    return (code * np.uint32(2654435761)) >> np.uint32(32 - bits)


def trigram_counts(text: str, bits: int, letters_only: bool = True) -> np.ndarray:
    return np.bincount(trigram_bins(text, bits, letters_only), minlength=1 << bits)
