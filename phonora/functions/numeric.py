"""Arithmetic of signals, frames, schedules and dense vectors as Column builders."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def frame_count(samples: Column, stride: int | None) -> Column:
    """Frames of a signal; without a stride (raw audio) its samples."""
    return samples if stride is None else 1 + F.floor(samples / F.lit(stride))


def next_power_of_two(x: Column) -> Column:
    """The smallest power of two from ``x`` up; 1 for 0."""
    return F.when(x <= 1, F.lit(1).cast("long")).otherwise(F.pow(F.lit(2.0), F.length(F.bin((x - 1).cast("long")))).cast("long"))


def ms_to_samples(milliseconds: Column, sample_rate: int) -> Column:
    """Truncated towards zero."""
    return ((milliseconds / 1000) * sample_rate).cast("int")


def padding(kernel: int, stride: int = 1, stft: bool = False) -> tuple[int, int]:
    half = kernel // 2
    if stft:
        return (half, half - (stride == 1))
    return (half, kernel - 1) if stride > 1 else (half, half)


def conv_length(lengths: Column, kernel: int, stride: int = 1, use_padding: bool = True, stft: bool = False) -> Column:
    pad = sum(padding(kernel, stride, stft)) if use_padding else 0
    return F.floor((lengths + (pad - kernel)) / F.lit(stride)) + 1


def conv_chain(lengths: Column, layers: Sequence[tuple[int, int]], use_padding: bool = True) -> Column:
    for kernel, stride in layers:
        lengths = conv_length(lengths, kernel, stride, use_padding)
    return lengths


def resampled_length(duration_s: Column, sample_rate: Column, target: int) -> Column:
    """Samples after resampling, rounded up.

    A signal has whole samples, so what the duration as a double misses of them is put right before rounding up.
    """
    samples = duration_s * sample_rate.cast("double")
    whole = F.rint(samples)
    samples = F.when(F.abs(samples - whole) <= samples * 1e-15, whole).otherwise(samples)
    return F.ceil(F.lit(target) * samples / sample_rate)


def log_compression(x: Column) -> Column:
    return F.log(x + 1e-5)


def log_softmax(values: Column) -> Column:
    """Element-wise over an array, shifted by its maximum."""
    top = F.array_max(values)
    total = F.log(F.aggregate(values, F.lit(0.0), lambda s, x: s + F.exp(x.cast("double") - top)))
    return F.transform(values, lambda x: x.cast("double") - top - total)


def softmax_concat(dependencies: Sequence[Column], hidden: Column) -> Column:
    """Hidden features followed by the softmax of each classifier that this one depends on."""
    return F.concat(hidden.cast("array<double>"), *[F.transform(log_softmax(d), F.exp) for d in dependencies])


def sinusoidal(position: Column, size: int) -> Column:
    """Positions as sine (even) and cosine (odd) of falling frequencies."""
    bases = [math.exp(-(i - i % 2) * math.log(10000.0) / size) for i in range(size)]
    return F.array(*[(F.sin if i % 2 == 0 else F.cos)(position * b) for i, b in enumerate(bases)])


def hamming(a: Column, b: Column) -> Column:
    """Components that differ; nulls are equal to each other."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x.eqNullSafe(y), 0).otherwise(1)), F.lit(0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def scaled_dot(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(F.size(a))


def vector_sum(vectors: Column, size: int) -> Column:
    """Sum of the vectors of an array: a composed embedding."""
    zero = F.array(*[F.lit(0.0)] * size)
    return F.aggregate(vectors, zero, lambda s, v: F.zip_with(s, v, lambda x, y: x + y.cast("double")))


def frobenius(weights: Column, initial: Column) -> Column:
    """Distance of a matrix, flattened, from its initial value."""
    return F.sqrt(F.aggregate(F.zip_with(weights, initial, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def length_mask(length: Column, longest: int, start: int = 0, inverse: bool = False) -> Column:
    """Booleans for positions ``start`` to ``longest``: inside the length, or outside if inverse."""
    inside = F.transform(F.sequence(F.lit(start), F.lit(longest - 1)), lambda i: i < length)
    return F.transform(inside, lambda x: ~x) if inverse else inside


def reflect_pad(values: Column, left: int, right: int) -> Column:
    """Values mirrored around both ends, the end itself not repeated."""
    n = F.size(values)
    head = F.reverse(F.slice(values, 2, left)) if left else F.slice(values, 1, 0)
    tail = F.reverse(F.slice(values, F.greatest(n - right, F.lit(1)), right)) if right else F.slice(values, 1, 0)
    return F.concat(head, values, tail)


def warmup_rate(step: Column, model_size: int, warmup: int, constant: int = 0, factor: float = 1.0) -> Column:
    """Learning rate: linear warm-up, constant, then decay by the inverse square root."""
    scale = factor * model_size**-0.5
    return (
        F.when(step < warmup, F.lit(scale) * step * warmup**-1.5)
        .when(step < warmup + constant, F.lit(scale * warmup**-0.5))
        .otherwise(F.lit(scale) * F.pow((step - constant).cast("double"), F.lit(-0.5)))
    )


def split_batch_size(batch: Column, factor: int) -> Column:
    """Batch size of each accumulation step; not divisible is an error."""
    return F.when(batch % factor == 0, F.floor(batch / factor)).otherwise(F.raise_error(F.lit(f"the batch size is not divisible by {factor}")).cast("long"))


def human_duration(seconds: Column) -> Column:
    return F.format_string("%d:%02d:%02d", F.floor(seconds / 3600), F.floor(seconds / 60) % 60, F.floor(seconds) % 60)


def incremental_mean(total: Column, count: Column) -> Column:
    return F.try_divide(total, count)
