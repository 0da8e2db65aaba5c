"""Actuator calibration: encoder counts, bounds, gripper conversions, joint signs."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from episcope.functions.columns import clip

# Fixed values of the calibration rules.
ENCODER_COUNTS = (2405, 3110)
ENCODER_ZERO = 2048
COUNTS_PER_REVOLUTION = 4096
ANCHOR_OUTPUTS = (0.0, 1.0)
ANCHOR_TOLERANCE = 1e-3
FAULTY_BOUNDS = (0.4, 1.5)
REPAIRED_BOUNDS = (0.5476, 1.6296)
LINEAR_BOUNDS = (0.01844, 0.05800)
JOINT_BOUNDS = (-0.6213, 1.4910)
ARM_LENGTH = 0.036
HORN_RADIUS = 0.022
JOINT_SIGNS = (1, -1, -1, 1, 1, 1, 1, 1, -1, -1, 1, 1, 1, 1)
GRIPPERS = (6, 13)


def encoder_to_radian(count: Column, zero: float = ENCODER_ZERO,
                      per_revolution: float = COUNTS_PER_REVOLUTION) -> Column:
    return (count.cast("double") - zero) * (2.0 * math.pi) / per_revolution


def _bounds(bounds: tuple[float, float]) -> tuple[float, float]:
    low, high = bounds
    if high <= low:
        raise ValueError("the upper bound must be above the lower one")
    return low, high


def rescale(x: Column, bounds: tuple[float, float]) -> Column:
    low, high = _bounds(bounds)
    return (x - low) / F.lit(high - low)


def unscale(x: Column, bounds: tuple[float, float]) -> Column:
    low, high = _bounds(bounds)
    return x * F.lit(high - low) + low


def gripper_to_angular(x: Column, bounds: tuple[float, float] = REPAIRED_BOUNDS) -> Column:
    """Linear gripper position to the normalised angle."""
    linear = unscale(x, LINEAR_BOUNDS)
    ratio = (HORN_RADIUS**2 + linear * linear - ARM_LENGTH**2) / (2 * HORN_RADIUS * linear)
    return rescale(F.asin(clip(ratio, -1.0, 1.0)), bounds)


def gripper_from_angular(x: Column) -> Column:
    return rescale(x + REPAIRED_BOUNDS[0], JOINT_BOUNDS)


def gripper_from_angular_inverse(x: Column) -> Column:
    return unscale(x, JOINT_BOUNDS) - REPAIRED_BOUNDS[0]


def flip_joints(vector: Column) -> Column:
    """Elementwise product with the joint signs (its own inverse)."""
    signs = F.array(*[F.lit(float(s)) for s in JOINT_SIGNS])
    return F.zip_with(vector, signs, lambda v, s: v.cast("double") * s)


def _at_grippers(vector: Column, rule) -> Column:
    return F.transform(vector, lambda v, i: F.when(i.isin(*GRIPPERS), rule(v)).otherwise(v))


def decode_state(vector: Column) -> Column:
    return _at_grippers(flip_joints(vector), gripper_to_angular)


def encode_actions(vector: Column) -> Column:
    return _at_grippers(flip_joints(vector), gripper_from_angular)


def encode_actions_inverse(vector: Column) -> Column:
    return _at_grippers(flip_joints(vector), gripper_from_angular_inverse)


def decode_action(x: Column, input_range: tuple[float, float], output_range: tuple[float, float]) -> Column:
    """Clip to the input range and map it linearly to the output range."""
    low, high = _bounds(input_range)
    out_low, out_high = output_range
    part = (clip(x, low, high) - low) / F.lit(high - low)
    return F.lit(out_low) + part * F.lit(out_high - out_low)


def round_trip_error(x: Column, bounds: tuple[float, float]) -> Column:
    return F.abs(unscale(rescale(x, bounds), bounds) - x)
