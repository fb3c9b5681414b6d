"""Sensor channels by name: packing, views and their contract."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinelink.functions import layouts as L
from kinelink.functions import quaternions as Q
from kinelink.functions.vectors import col

# The order of the four sensors in 48 numbers, and the named views.
SENSORS48 = ("L_LowArm", "R_LowArm", "L_LowLeg", "R_LowLeg")
VIEWS = {
    "auto": L.CANONICAL7,
    "canonical_7d": L.CANONICAL7,
    "legacy_7d": L.CANONICAL7,
    "acc_quat": L.CANONICAL7,
    "acc": L.ACC,
    "acc_magnitude": ("acc_magnitude", "acc_magnitude_centered"),
    "acc_changes": ("acc_dx", "acc_dy", "acc_dz", "acc_change_energy"),
    "gyro": L.GYRO,
    "mag": ("mag_x", "mag_y", "mag_z"),
    "acc_gyro": L.ACC + L.GYRO,
    "acc_gyro_quat": L.ACC + L.GYRO + L.QUAT,
    "gyro_quat": L.GYRO + L.QUAT,
    "legacy_48d": tuple(f"legacy_{i}" for i in range(48)),
    "quat": L.QUAT,
}


def view_channels(view: str | Sequence[str]) -> tuple[str, ...]:
    if isinstance(view, str):
        if view not in VIEWS:
            raise ValueError(f"unknown view {view!r}; there are {sorted(VIEWS)}")
        return VIEWS[view]
    if len(set(view)) != len(view):
        raise ValueError("a view names each channel once")
    return tuple(view)


def select_view(values: Column | str, have: Sequence[str], view: str | Sequence[str]) -> Column:
    """The view's channels in its order; a missing channel names those there are."""
    wanted = view_channels(view)
    missing = [c for c in wanted if c not in have]
    if missing:
        raise ValueError(f"channels {missing} are missing; there are {list(have)}")
    return F.array(*(F.get(col(values), F.lit(list(have).index(c))) for c in wanted))


def view_hash(view: str | Sequence[str]) -> str:
    """SHA-256 of the view's canonical description."""
    return hashlib.sha256(json.dumps({"channels": list(view_channels(view))}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def default_channels(width: int) -> tuple[str, ...]:
    """Names for unnamed columns: seven mean acceleration and quaternion, any other width is numbered."""
    return L.CANONICAL7 if width == 7 else tuple(f"legacy_{i}" for i in range(width))


def infer_metadata(name: Column | str) -> Column:
    """struct(unit, kind) of a channel by its prefix; what is not known stays 'unknown'."""
    n = col(name)
    starts = lambda p: F.startswith(n, F.lit(p))
    unit = F.when(starts("acc_"), "m/s^2").when(starts("gyro_"), "rad/s").when(starts("quat_"), "1").otherwise("unknown")
    kind = F.when(starts("acc_"), "acceleration").when(starts("gyro_"), "angular_velocity").when(starts("quat_"), "orientation").otherwise("unknown")
    return F.struct(unit.alias("unit"), kind.alias("kind"))


def pack_7d(acc: Column | str, quat: Column | str) -> Column:
    return F.concat(col(acc), col(quat))


def pack_48d(quats: Sequence[Column], accs: Sequence[Column]) -> Column:
    """Rotation matrices of the four sensors, then their accelerations."""
    return F.concat(*(Q.to_matrix(q) for q in quats), *accs)


def unpack_48d(values: Column | str, sensor: str = "L_LowArm") -> Column:
    """Acceleration and quaternion of one sensor out of 48 numbers."""
    k = SENSORS48.index(sensor)
    return F.concat(F.slice(col(values), 36 + 3 * k + 1, 3), Q.from_matrix(F.slice(col(values), 9 * k + 1, 9)))


def repeat_sensor_48d(seven: Column | str) -> Column:
    """48 numbers with one sensor's reading in all four places."""
    acc, quat = F.slice(col(seven), 1, 3), F.slice(col(seven), 4, 4)
    return pack_48d([quat] * 4, [acc] * 4)
