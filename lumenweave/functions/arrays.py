"""Arrays as images, token sequences and scores, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the sequence layout.
IMAGE_TOKEN, BOS_TOKEN, EOS_TOKEN, SEPARATOR_TOKEN, TEXT_BOS, TEXT_EOS = -200, 4118, 4118, 10494, 817, 0
PADDING = {"input_ids": 0, "pixel_values": 0, "attention_mask": 0, "labels": -100, "task": -1}
MASKED_LABEL = -100


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where the body uses it in a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def number_of_patches(height: Column, width: Column, patch: int) -> Column:
    """Patches of a picture; raises if a side is no multiple of the patch."""
    whole = (height % patch == 0) & (width % patch == 0)
    return F.when(whole, (height / patch).cast("int") * (width / patch).cast("int")).otherwise(F.raise_error(F.lit("a side is no multiple of the patch")))


def patchify(pixels: Column, height: int, width: int, patch: int, channels: int = 1) -> Column:
    """Patches, row by row, of a picture stored channel by channel; each lists its rows' pixels, with the channel last."""
    if height % patch or width % patch:
        raise ValueError("a side is no multiple of the patch")
    across = width // patch
    numbers = F.sequence(F.lit(0), F.lit((height // patch) * across - 1))
    inside = F.sequence(F.lit(0), F.lit(patch * patch * channels - 1))

    def pixel(n: Column, k: Column) -> Column:
        place, channel = F.floor(k / channels), k % channels
        row = F.floor(n / across) * patch + F.floor(place / patch)
        column = (n % across) * patch + place % patch
        return F.get(pixels, (channel * height * width + row * width + column).cast("int"))

    return F.transform(numbers, lambda n: F.transform(inside, lambda k: pixel(n, k)))


def hwc_to_chw(pixels: Column, height: int, width: int, channels: int) -> Column:
    """From channel last to channel first."""
    numbers = F.sequence(F.lit(0), F.lit(height * width * channels - 1))
    return F.transform(numbers, lambda k: F.get(pixels, ((k % (height * width)) * channels + F.floor(k / (height * width))).cast("int")))


def normalize_pixels(pixels: Column, mean: Column, std: Column, *, rescale: float = 1 / 255) -> Column:
    """Rescaled, then shifted and divided by the channel's mean and deviation."""
    return F.transform(pixels, lambda v: (v.cast("double") * rescale - mean) / std)


def bilinear_weights(source: int, target: int) -> np.ndarray:
    """How much each place of the source counts for each place of the target: a triangle around its centre, as wide as a target's step if that is more than one."""
    step = source / target
    centre, place = (np.arange(target) + 0.5) * step, np.arange(source) + 0.5
    weight = np.maximum(0.0, 1.0 - np.abs(place[None, :] - centre[:, None]) / max(step, 1.0))
    return weight / weight.sum(1, keepdims=True)


def resize_pixels(pixels: Column, height: Column, width: Column, target_height: Column, target_width: Column) -> Column:
    """One channel, rows one after the other, resized by bilinear weights; null where the sides are not those of the array.

    Pictures of one size in a batch are resized at once.
    """

    @F.pandas_udf("array<double>")
    def resized(values: pd.Series, h: pd.Series, w: pd.Series, th: pd.Series, tw: pd.Series) -> pd.Series:
        sides = pd.DataFrame({"h": h, "w": w, "th": th, "tw": tw})
        out = pd.Series([None] * len(values), dtype=object)
        for (a, b, c, d), rows in sides.dropna().groupby(["h", "w", "th", "tw"]).groups.items():
            a, b, c, d = int(a), int(b), int(c), int(d)
            own = [i for i in rows if values[i] is not None and min(a, b, c, d) > 0 and len(values[i]) == a * b]
            if own:
                stacked = np.stack([np.asarray(values[i], float) for i in own]).reshape(-1, a, b)
                made = bilinear_weights(a, c) @ stacked @ bilinear_weights(b, d).T
                for i, picture in zip(own, made, strict=True):
                    out[i] = picture.ravel()
        return out

    return resized(pixels.cast("array<double>"), height, width, target_height, target_width)


def pad_image(pixels: Column, height: int, width: int, size: int, value: float = 1.0) -> Column:
    """One channel padded at the right and the bottom to a square."""
    rows = F.transform(F.sequence(F.lit(0), F.lit(height - 1)), lambda r: F.concat(F.slice(pixels, (r * width + 1).cast("int"), F.lit(width)), F.array_repeat(F.lit(value).cast("double"), size - width)))
    return F.concat(F.flatten(rows), F.array_repeat(F.lit(value).cast("double"), (size - height) * size))


def image_tokens(rows: Column, columns: Column) -> Column:
    """The token grid: a start, then each row's image tokens and a separator, the last separator being the end."""
    row = F.concat(F.array_repeat(F.lit(IMAGE_TOKEN), columns.cast("int")), F.array(F.lit(SEPARATOR_TOKEN)))
    last = F.concat(F.array_repeat(F.lit(IMAGE_TOKEN), columns.cast("int")), F.array(F.lit(EOS_TOKEN)))
    return F.concat(F.array(F.lit(BOS_TOKEN)), F.flatten(F.array_repeat(row, rows.cast("int") - 1)), last)


def top_k_filter(scores: Column, k: int, filler: float = float("-inf")) -> Column:
    """Scores below the k-th largest become the filler; ties with it stay."""
    least = F.get(F.sort_array(scores, asc=False), F.least(F.lit(k), F.size(scores)) - 1)
    return let(least, lambda x: F.transform(scores, lambda v: F.when(v < x, F.lit(filler).cast("double")).otherwise(v.cast("double"))))


def softmax(scores: Column) -> Column:
    powers = let(F.array_max(scores), lambda top: F.transform(scores, lambda v: F.exp((v - top).cast("double"))))
    return let(powers, lambda p: let(F.aggregate(p, F.lit(0.0), lambda a, x: a + x), lambda whole: F.transform(p, lambda v: v / whole)))


def nucleus_filter(scores: Column, p: float, filler: float = float("-inf")) -> Column:
    """From the smallest score up, those whose cumulative probability is at most ``1 - p`` become the filler.

    Nothing changes unless ``0 < p < 1``.
    """
    if not 0 < p < 1:
        return F.transform(scores, lambda v: v.cast("double"))
    # exp(score - top) in ascending order; its running sum against (1 - p) of the whole.
    powers = let(F.array_max(scores), lambda top: F.transform(F.sort_array(scores), lambda v: F.exp((v - top).cast("double"))))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"))

    def removed(ps: Column, whole: Column) -> Column:
        def step(a: Column, x: Column) -> Column:
            return F.struct((a["sum"] + x).alias("sum"), (a["n"] + F.when(a["sum"] + x <= F.lit(1 - p) * whole, 1).otherwise(0)).alias("n"))

        return F.aggregate(ps, start, step)["n"]

    n = let(powers, lambda ps: let(F.aggregate(ps, F.lit(0.0), lambda a, x: a + x), lambda whole: removed(ps, whole)))
    pairs = F.array_sort(F.transform(scores, lambda v, i: F.struct(v.cast("double").alias("v"), i.alias("i"))))
    gone = F.transform(F.slice(pairs, F.lit(1), n), lambda t: t["i"])
    return let(gone, lambda g: F.transform(scores, lambda v, i: F.when(F.array_contains(g, i), F.lit(filler).cast("double")).otherwise(v.cast("double"))))


def argmax(scores: Column) -> Column:
    """The index, from 0, of the first largest score."""
    return F.array_position(scores, F.array_max(scores)).cast("long") - 1


def repetition_penalty(scores: Column, seen: Column, penalty: float) -> Column:
    """Scores of tokens already seen: negative ones times the penalty, the others divided by it."""

    def one(v: Column, i: Column) -> Column:
        penalized = F.when(v < 0, v.cast("double") * penalty).otherwise(v.cast("double") / penalty)
        return F.when(F.array_contains(seen, i), penalized).otherwise(v.cast("double"))

    return F.transform(scores, one)


def label_mask(turns: Column, is_target: Column) -> Column:
    """One array of labels: the tokens of target turns, and the mask for the others. ``turns`` is an array of token arrays."""
    masked = F.zip_with(turns, is_target, lambda t, keep: F.when(keep, t).otherwise(F.array_repeat(F.lit(MASKED_LABEL), F.size(t))))
    return F.flatten(masked)


def ones_like(tokens: Column) -> Column:
    return F.array_repeat(F.lit(1), F.size(tokens))


def pad(tokens: Column, length: Column, value: int, *, side: str = "right") -> Column:
    """Padded to the length at the left or the right; longer arrays stay."""
    filler = F.array_repeat(F.lit(value), F.greatest(length.cast("int") - F.size(tokens), F.lit(0)))
    return F.concat(filler, tokens) if side == "left" else F.concat(tokens, filler)


def assemble(image: Column, instruction: Column, text: Column, *, order: str, max_length: int) -> Column:
    """One sequence, cut to the length: image tokens first, the instruction first, or text only."""
    parts = {"image": [image, instruction, text], "instruction": [instruction, image, text], "text": [instruction, text]}[order]
    return F.slice(F.concat(*parts), 1, max_length)
