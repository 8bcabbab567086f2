"""Perceptual hashes of gray images (FN20-FN25), NumPy kernels over stacks.

These run inside ``mapInArrow`` tasks (``dupstream.sources.images``): Spark partitions
the images, each task stacks its images of equal size and hashes a stack at once.

* luma: weighted R, G, B in 16-bit fixed point (8-bit gray);
* resize: separable Lanczos (a = 3) with the kernel widened by the down-scale
  factor, weights in 22-bit fixed point and 8-bit rounding after each pass, one
  matrix product a pass.  Products and sums of whole numbers stay below 2**53, so
  float64 matrix products are exact and the result is the same on every machine
  (and in SQL).  This follows the usual antialiasing resampler; parity with a
  particular imaging library is not claimed;
* aHash: bit = pixel below the integer mean; dHash: bit = pixel below its
  right (horizontal) or lower (vertical) neighbour; bits are read row-major,
  most significant first, and cut into signed 64-bit words.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

# ---- fixed values (gray conversion weights, 16-bit fixed point) ----------
LUMA_R, LUMA_G, LUMA_B, LUMA_ROUND, LUMA_SHIFT = 19595, 38470, 7471, 32768, 16
# --------------------------------------------------------------------------
LANCZOS_A = 3.0
WEIGHT_BITS = 22


def luma(bgr: np.ndarray) -> np.ndarray:
    """FN20: 8-bit gray from an (h, w, 3|4) array in B, G, R(, A) order."""
    b = bgr[..., 0].astype(np.int64)
    g = bgr[..., 1].astype(np.int64)
    r = bgr[..., 2].astype(np.int64)
    return ((LUMA_R * r + LUMA_G * g + LUMA_B * b + LUMA_ROUND) >> LUMA_SHIFT).astype(np.uint8)


def _lanczos(x: np.ndarray) -> np.ndarray:
    out = np.sinc(x) * np.sinc(x / LANCZOS_A)
    return np.where(np.abs(x) < LANCZOS_A, out, 0.0)


@lru_cache(maxsize=256)
def _weights(n_in: int, n_out: int) -> np.ndarray:
    """(n_out, n_in) resampling matrix (cached per size pair; read-only)."""
    scale = n_in / n_out
    fscale = max(scale, 1.0)
    support = LANCZOS_A * fscale
    w = np.zeros((n_out, n_in))
    for o in range(n_out):
        center = (o + 0.5) * scale
        lo = max(int(center - support + 0.5), 0)
        hi = min(int(center + support + 0.5), n_in)
        idx = np.arange(lo, hi)
        k = _lanczos((idx - center + 0.5) / fscale)
        s = k.sum()
        w[o, lo:hi] = k / s if s != 0 else 0.0
    w.setflags(write=False)
    return w


@lru_cache(maxsize=256)
def fixed_weights(n_in: int, n_out: int) -> np.ndarray:
    """The resampling matrix in whole numbers of 1 / 2**WEIGHT_BITS."""
    w = np.rint(_weights(n_in, n_out) * (1 << WEIGHT_BITS))
    w.setflags(write=False)
    return w


def _levels(sums: np.ndarray) -> np.ndarray:
    """Fixed-point sums to gray levels, rounded."""
    return np.clip((sums.astype(np.int64) + (1 << (WEIGHT_BITS - 1))) >> WEIGHT_BITS, 0, 255)


def resize_stack(stack: np.ndarray, width: int, height: int) -> np.ndarray:
    """FN21: Lanczos resize of an (n, h, w) uint8 stack to (n, height, width)."""
    n, h, w = stack.shape
    rows = _levels(stack.reshape(n * h, w).astype(np.float64) @ fixed_weights(w, width).T).reshape(n, h, width)
    columns = rows.transpose(1, 0, 2).reshape(h, n * width).astype(np.float64)
    return _levels(fixed_weights(h, height) @ columns).reshape(height, n, width).transpose(1, 0, 2).astype(np.uint8)


def resize(gray: np.ndarray, width: int, height: int) -> np.ndarray:
    """One (h, w) image."""
    return resize_stack(gray[None], width, height)[0]


def pack_words(bits: np.ndarray) -> np.ndarray:
    """FN10 on (n, k * 64) 0/1 rows: (n, k) signed words, most significant bit first."""
    return np.packbits(bits.reshape(len(bits), -1).astype(np.uint8), axis=1).view(">i8").astype(np.int64)


def bits_to_words(bits: np.ndarray) -> list[int]:
    """One 0/1 vector as signed 64-bit words."""
    return pack_words(np.asarray(bits)[None])[0].tolist()


def below_mean(px: np.ndarray) -> np.ndarray:
    """FN22/FN24 bits of (n, side, side) thumbnails: pixel < floor(mean)."""
    flat = px.reshape(len(px), -1).astype(np.int64)
    return flat < (flat.sum(axis=1) // flat.shape[1])[:, None]


def ahash_bits(gray: np.ndarray, side: int) -> np.ndarray:
    return below_mean(resize_stack(gray[None], side, side))[0].astype(np.uint8)


def dhash_h_bits(gray: np.ndarray, side: int) -> np.ndarray:
    """FN23/FN24: (side+1) x side thumbnail, bit = pixel < right neighbour."""
    return _rising(resize_stack(gray[None], side + 1, side), 2)[0].astype(np.uint8)


def dhash_v_bits(gray: np.ndarray, side: int) -> np.ndarray:
    """FN23/FN24: side x (side+1) thumbnail, bit = pixel < lower neighbour."""
    return _rising(resize_stack(gray[None], side, side + 1), 1)[0].astype(np.uint8)


def _rising(px: np.ndarray, axis: int) -> np.ndarray:
    a, b = (px[:, :, :-1], px[:, :, 1:]) if axis == 2 else (px[:, :-1], px[:, 1:])
    return (a < b).reshape(len(px), -1)


def fingerprints(stack: np.ndarray) -> dict[str, np.ndarray]:
    """The live fingerprints of an (n, h, w) uint8 stack: ``words`` (n, 12), the 256-bit
    aHash, dHash_h and dHash_v; the 64-bit hashes (n,); and ``vector768`` (n, 768), the 0/1
    vector with a fractional mean (FN25)."""
    big = resize_stack(stack, 16, 16)
    dh, dv = _rising(resize_stack(stack, 17, 16), 2), _rising(resize_stack(stack, 16, 17), 1)
    flat = big.reshape(len(big), -1).astype(np.int64)
    fractional = flat * flat.shape[1] < flat.sum(axis=1)[:, None]
    return {
        "words": np.concatenate([pack_words(below_mean(big)), pack_words(dh), pack_words(dv)], axis=1),
        "ahash64": pack_words(below_mean(resize_stack(stack, 8, 8)))[:, 0],
        "dhash_h64": pack_words(_rising(resize_stack(stack, 9, 8), 2))[:, 0],
        "dhash_v64": pack_words(_rising(resize_stack(stack, 8, 9), 1))[:, 0],
        "vector768": np.concatenate([fractional, dh, dv], axis=1).astype(np.int8),
    }
