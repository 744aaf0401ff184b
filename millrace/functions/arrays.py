"""Functions on arrays of numbers and on samples of text."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, functions as F

IGNORED = -100  # the label of a padded place


def normalised(values: Column, mean: float, std: float) -> Column:
    """(x - mean) / std of each element."""
    return F.transform(values, lambda x: (x.cast("double") - mean) / std)


def prompt(instruction: Column, given: Column, output: Column) -> Column:
    """Instruction, input and response under headings; no input section where the input is null or empty."""
    section = F.when(F.coalesce(given, F.lit("")) != "", F.concat(F.lit("### Input:\n"), given, F.lit("\n\n"))).otherwise("")
    return F.concat(F.lit("### Instruction:\n"), instruction, F.lit("\n\n"), section, F.lit("### Response:\n"), output)


def tokens(text: Column, length: int, pad: str = "<pad>") -> Column:
    """The first `length` white-space tokens, padded to it."""
    words = F.slice(F.filter(F.split(text, r"\s+"), lambda w: w != ""), 1, length)
    return F.concat(words, F.array_repeat(F.lit(pad), F.lit(length) - F.size(words)))


def labels(ids: Column, mask: Column) -> Column:
    """ids where the mask is 1, IGNORED on padding."""
    return F.zip_with(ids, mask, lambda i, m: F.when(m == 1, i).otherwise(IGNORED))


#: Fixed values, by matrix: luma's factor, then red by v, green by u and v, blue by u; in the order of the standards' numbers from 1 on.
YUV_TO_RGB = {
    "bt709": (1.1644, 1.8337, -0.2181, -0.5451, 2.1606),
    "unspecified": (1.1644, 1.8337, -0.2181, -0.5451, 2.1606),
    "reserved": (1.1644, 1.8337, -0.2181, -0.5451, 2.1606),
    "fcc": (1.1644, 1.6301, -0.3864, -0.8289, 2.0726),
    "bt470": (1.1644, 1.6325, -0.4007, -0.8315, 2.0633),
    "bt601": (1.1644, 1.6325, -0.4007, -0.8315, 2.0633),
    "smpte240m": (1.1644, 1.8351, -0.2639, -0.5550, 2.1262),
    "ycgco": (1.1644, 1.8337, -0.2181, -0.5451, 2.1606),
    "bt2020": (1.1689, 1.7237, -0.1924, -0.6679, 2.1992),
    "bt2020c": (1.1689, 1.7237, -0.1924, -0.6679, 2.1992),
}
MATRICES = tuple(YUV_TO_RGB)


def nv12_to_rgb(frames: np.ndarray, matrix: str | int = "bt709", *, bgr: bool = False, full_range: bool = False) -> np.ndarray:
    """Frames [N, H * 3 / 2, W] of 8-bit NV12 as [N, 3, H, W]: a plane of luma, then half-size interleaved chroma. matrix: a name of
    MATRICES, or its number from 1 on; other numbers mean bt709. Computed in 32 bits and cut off, not rounded. full_range: luma goes from 0
    to 255 instead of from 16 to 235, and nothing is stretched."""
    if frames.ndim == 2:
        frames = frames[None]
    n, rows, width = frames.shape
    if rows % 3 or width % 2:
        raise ValueError("an NV12 frame has rows divisible by 3 and an even width")
    height = rows * 2 // 3
    if isinstance(matrix, int):
        matrix = MATRICES[matrix - 1] if 1 <= matrix <= len(MATRICES) else "bt709"
    luma, rv, gu, gv, bu = np.array(YUV_TO_RGB[matrix], np.float32)
    y = frames[:, :height].astype(np.float32)
    uv = frames[:, height:].reshape(n, height // 2, width // 2, 2).astype(np.float32) - np.float32(128)
    u, v = (np.repeat(np.repeat(uv[..., k], 2, 1), 2, 2) for k in (0, 1))
    if full_range:
        rv, gu, gv, bu = (c / luma for c in (rv, gu, gv, bu))
    else:
        y = (y - np.float32(16)) * luma
    r, g, b = y + rv * v, y + gu * u + gv * v, y + bu * u
    planes = (b, g, r) if bgr else (r, g, b)
    return np.clip(np.stack(planes, 1), 0, 255).astype(np.uint8)


def keyframe_cuts(is_key: Column) -> Column:
    """From an array of key flags of packets in order: the places at which a decoder can start, as an array of indices."""
    return F.filter(F.transform(is_key, lambda k, i: F.when(k, i)), lambda i: i.isNotNull())


def timestamps(packets: Column, start: Column, end: Column) -> Column:
    """Presentation times of an array of struct<pts, num, den> within [start, end), sorted."""
    times = F.transform(packets, lambda p: p["pts"] * p["num"].cast("double") / p["den"])
    return F.array_sort(F.filter(times, lambda t: (start.isNull() | (t >= start)) & (end.isNull() | (t < end))))
