"""Image fingerprints over decoded pixels (height x width x channels arrays)."""

from __future__ import annotations

import numpy as np

INK, FRAME, LINE, LEAST_SIDE, NOISE = 245, 0.9, 0.5, 20, 24
GRID = 24


def grey(pixels: np.ndarray) -> np.ndarray:
    """Luma of RGB(A) pixels; grey pixels as they are."""
    if pixels.ndim == 2 or pixels.shape[2] == 1:
        return pixels.reshape(pixels.shape[:2]).astype(float)
    return pixels[..., :3].astype(float) @ np.array([0.299, 0.587, 0.114])


def shrunk(values: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area means on a coarser grid."""

    def weights(n: int, m: int) -> np.ndarray:
        edges = np.linspace(0, n, m + 1)
        cells = np.arange(n)
        return np.clip(np.minimum(edges[1:, None], cells + 1) - np.maximum(edges[:-1, None], cells), 0, None) / (n / m)

    return weights(values.shape[0], height) @ values @ weights(values.shape[1], width).T


def extent(mask: np.ndarray) -> np.ndarray:
    """A mask cropped to where it is true; as it is where it is nowhere."""
    rows, columns = np.flatnonzero(mask.any(1)), np.flatnonzero(mask.any(0))
    return mask[rows[0] : rows[-1] + 1, columns[0] : columns[-1] + 1] if rows.size else mask


def autocropped(pixels: np.ndarray, tolerance: int = NOISE) -> np.ndarray:
    """Without the border of the corner's colour."""
    differs = grey(np.abs(pixels.astype(int) - pixels[0, 0].astype(int)).astype(float)) > tolerance
    rows, columns = np.flatnonzero(differs.any(1)), np.flatnonzero(differs.any(0))
    return pixels[rows[0] : rows[-1] + 1, columns[0] : columns[-1] + 1] if rows.size else pixels


def perceptual_hash(values: np.ndarray, side: int = 8) -> str:
    """Hex digits of the low frequencies above their median."""
    n = side * 4
    small = shrunk(values, n, n)
    base = np.cos(np.pi * np.outer(np.arange(n), 2 * np.arange(n) + 1) / (2 * n))
    low = (base @ small @ base.T)[:side, :side]
    bits = (low > np.median(low)).reshape(-1)
    return f"{int(''.join('1' if b else '0' for b in bits), 2):0{side * side // 4}x}"


def ink_content(pixels: np.ndarray) -> np.ndarray:
    """The ink as a mask, cropped to its extent, inside up to two frames drawn around it."""
    mask = extent(grey(pixels) < INK)
    for _ in range(2):
        height, width = mask.shape
        if min(height, width) < LEAST_SIDE or min(mask[0].mean(), mask[-1].mean(), mask[:, 0].mean(), mask[:, -1].mean()) < FRAME:
            break

        def depth(lines: np.ndarray, most: int) -> int:
            thin = np.flatnonzero(lines[:most].mean(1) <= LINE)
            return int(thin[0]) if thin.size else most

        top, bottom = depth(mask, height // 4), depth(mask[::-1], height // 4)
        left, right = depth(mask.T, width // 4), depth(mask.T[::-1], width // 4)
        mask = extent(mask[top : height - bottom, left : width - right])
    return mask


def ink_hash(pixels: np.ndarray) -> str:
    return perceptual_hash(np.where(ink_content(pixels), 0.0, 255.0), 16)


def ink_vector(pixels: np.ndarray) -> np.ndarray:
    small = shrunk(ink_content(pixels).astype(float), GRID, GRID)
    return small - small.mean()


def ink_correlation(a: np.ndarray, b: np.ndarray) -> float:
    x, y = ink_vector(a), ink_vector(b)
    norm = float(np.linalg.norm(x) * np.linalg.norm(y))
    return float((x * y).sum()) / norm if norm else 0.0


def hash_similarity(a: str, b: str) -> float:
    """Percent of equal bits, to one decimal."""
    bits = 4 * len(a)
    return round((1 - (int(a, 16) ^ int(b, 16)).bit_count() / bits) * 100, 1)


def on_white(pixels: np.ndarray) -> np.ndarray:
    """RGBA pixels laid on white; others as they are."""
    if pixels.ndim < 3 or pixels.shape[2] < 4:
        return pixels
    share = pixels[..., 3:].astype(float) / 255.0
    return np.rint(pixels[..., :3] * share + 255.0 * (1.0 - share)).astype(np.uint8)


def upright(pixels: np.ndarray, flip_x: bool, flip_y: bool, inverted: bool = False) -> np.ndarray:
    """Pixels as a page shows them: unflipped, and out of the inverted four-ink form into red, green and blue."""
    if inverted and pixels.ndim == 3 and pixels.shape[2] == 4:
        ink = pixels.astype(float) / 255.0
        pixels = np.rint(255.0 * ink[..., :3] * ink[..., 3:]).astype(np.uint8)
    return pixels[:: -1 if flip_y else 1, :: -1 if flip_x else 1]


def prepared(pixels: np.ndarray, longest: int) -> np.ndarray:
    """On white, without its border, and no edge longer than ``longest``."""
    bare = autocropped(on_white(pixels))
    height, width = bare.shape[:2]
    if max(height, width) <= longest:
        return bare
    size = [max(1, round(n * longest / max(height, width))) for n in (height, width)]
    planes = bare.reshape(height, width, -1).astype(float)
    return np.rint(np.stack([shrunk(planes[..., k], *size) for k in range(planes.shape[2])], axis=2)).astype(np.uint8)


def pair_score(a: np.ndarray, b: np.ndarray, formula: bool) -> float:
    """Percent: of a formula the hashes' likeness, of a figure the better of hashes and ink."""
    plain = hash_similarity(*(perceptual_hash(grey(autocropped(on_white(x)))) for x in (a, b)))
    return plain if formula else max(plain, hash_similarity(ink_hash(on_white(a)), ink_hash(on_white(b))))
