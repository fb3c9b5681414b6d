"""Column functions on skeletons: arrays of structs x, y, z."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinelink.functions import layouts as L
from kinelink.functions.vectors import col


def xyz(x, y, z) -> Column:
    lit = lambda v: v.cast("double") if isinstance(v, Column) else F.lit(float(v))
    return F.struct(lit(x).alias("x"), lit(y).alias("y"), lit(z).alias("z"))


def joint(joints: Column | str, i: int) -> Column:
    return F.get(col(joints), F.lit(i))


def add(a: Column, b: Column, scale: float = 1.0) -> Column:
    return xyz(a["x"] + scale * b["x"], a["y"] + scale * b["y"], a["z"] + scale * b["z"])


def minus(a: Column, b: Column) -> Column:
    return add(a, b, -1.0)


def middle(a: Column, b: Column) -> Column:
    return xyz((a["x"] + b["x"]) / 2, (a["y"] + b["y"]) / 2, (a["z"] + b["z"]) / 2)


def times(a: Column, s: Column | float) -> Column:
    return xyz(a["x"] * s, a["y"] * s, a["z"] * s)


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def cross(a: Column, b: Column) -> Column:
    return xyz(a["y"] * b["z"] - a["z"] * b["y"], a["z"] * b["x"] - a["x"] * b["z"], a["x"] * b["y"] - a["y"] * b["x"])


def length(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Column, b: Column) -> Column:
    return length(minus(a, b))


def flat(a: Column) -> Column:
    return xyz(a["x"], a["y"], 0.0)


def coco17_to_h36m17(joints: Column | str) -> Column:
    """Two-dimensional layout change: midpoints for trunk joints, depth 0, the nose stands at the neck, the head beyond it."""
    j = lambda name: flat(joint(joints, L.COCO17.index(name)))
    pelvis, thorax = middle(j("left_hip"), j("right_hip")), middle(j("left_shoulder"), j("right_shoulder"))
    nose = j("nose")
    made = {"pelvis": pelvis, "thorax": thorax, "spine": middle(pelvis, thorax), "neck": nose, "head": add(nose, minus(nose, middle(thorax, nose)), 0.5)}
    return F.array(*(made[n] if n in made else j(n) for n in L.H36M17))


def smplx25_to_h36m17(joints: Column | str) -> Column:
    """From the first 25 body points: spine and thorax are midpoints, the nose stands at the neck, the head beyond it."""
    j = lambda i: joint(joints, i)
    thorax, nose = middle(j(8), j(9)), j(24)
    made = {"thorax": thorax, "spine": middle(j(0), thorax), "neck": nose, "head": add(nose, minus(nose, j(7)), 0.5)}
    return F.array(*(made[n] if n in made else j(L.SMPLX25[n]) for n in L.H36M17))


def capture21_to_h36m17(joints: Column | str, names: Sequence[str]) -> Column:
    """Joints of a motion-capture skeleton picked by name; a missing name fails."""
    return pick_by_name(joints, names, [(n,) for n in L.CAPTURE21])


def pick_by_name(joints: Column | str, names: Sequence[str], wanted: Sequence[Sequence[str]]) -> Column:
    """Joints in the wanted order, each by the first of its names that the layout has; a missing one fails."""
    return F.array(*(joint(joints, L.required(names, *w)) for w in wanted))


def pick_by_index(joints: Column | str, order: Sequence[int | tuple[int, int]]) -> Column:
    """Joints by index; a pair of indices is their midpoint."""
    return F.array(*(joint(joints, i) if isinstance(i, int) else middle(joint(joints, i[0]), joint(joints, i[1])) for i in order))


def root_torso_normalize(joints: Column | str, root: int = 0, torso: int = 8, floor: float = 1e-6) -> Column:
    """Joints from the root in torso lengths."""
    scale = F.greatest(distance(joint(joints, root), joint(joints, torso)), F.lit(floor))
    return F.transform(col(joints), lambda p: times(minus(p, joint(joints, root)), 1 / scale))


def torso_audit(joints: Column | str, root: int = 0, torso: int = 8, floor: float = 1e-6) -> Column:
    """struct(joints, valid): like root_torso_normalize, but a bad torso length counts as 1 and is told."""
    scale = distance(joint(joints, root), joint(joints, torso))
    valid = scale.isNotNull() & ~F.isnan(scale) & (scale > floor)
    return F.struct(F.transform(col(joints), lambda p: times(minus(p, joint(joints, root)), 1 / F.when(valid, scale).otherwise(1.0))).alias("joints"), valid.alias("valid"))


def screen_calibrate(joints: Column | str, torso_px: float = 171.0, centre: tuple[float, float] = (960.0, 540.0), root: int = 0, torso: int = 8) -> Column:
    """Joints on the screen: torso of given size around the centre, depth 0; a bad torso scales by the size itself."""
    size = distance(flat(joint(joints, root)), flat(joint(joints, torso)))
    scale = F.when(size.isNotNull() & ~F.isnan(size) & (size > 1e-6), torso_px / size).otherwise(torso_px)
    return F.transform(col(joints), lambda p: xyz((p["x"] - joint(joints, root)["x"]) * scale + centre[0], (p["y"] - joint(joints, root)["y"]) * scale + centre[1], 0.0))


def valid_joints(joints: Column | str, confidence: Column | None = None) -> Column:
    """Per joint: finite, and with confidence above 0 if given."""
    finite = F.transform(col(joints), lambda p: F.coalesce(~F.isnan(p["x"]) & ~F.isnan(p["y"]) & ~F.isnan(p["z"]) & (F.abs(p["x"]) < float("inf")) & (F.abs(p["y"]) < float("inf")) & (F.abs(p["z"]) < float("inf")), F.lit(False)))
    return finite if confidence is None else F.zip_with(finite, confidence, lambda f, c: f & F.coalesce(c > 0, F.lit(False)))


def shown(joints: Column | str, visible: Column | str) -> Column:
    return F.transform(F.filter(F.arrays_zip(col(joints).alias("j"), col(visible).alias("v")), lambda z: z["v"]), lambda z: z["j"])


def bbox_of(points: Column) -> Column:
    """Smallest box around points; null for none."""
    axis = lambda a: F.transform(points, lambda p: p[a])
    return F.when(F.size(points) > 0, F.struct(F.array_min(axis("x")).alias("x1"), F.array_min(axis("y")).alias("y1"), F.array_max(axis("x")).alias("x2"), F.array_max(axis("y")).alias("y2")))


def bbox_normalize(joints: Column | str, visible: Column | str, floor: float = 1e-5) -> Column:
    """Visible joints from their box's centre by its larger side; hidden ones are 0."""
    box = bbox_of(shown(joints, visible))
    side = F.greatest(box["x2"] - box["x1"], box["y2"] - box["y1"], F.lit(floor))
    zero = xyz(0.0, 0.0, 0.0)
    return F.zip_with(col(joints), col(visible), lambda p, v: F.when(v & box.isNotNull(), xyz((p["x"] - (box["x1"] + box["x2"]) / 2) / side, (p["y"] - (box["y1"] + box["y2"]) / 2) / side, 0.0)).otherwise(zero))


def pose_bbox(joints: Column | str) -> Column:
    """Box around the joints that are not exactly at 0, 0; zeros where there is none."""
    real = F.filter(col(joints), lambda p: ~((p["x"] == 0) & (p["y"] == 0)))
    zero = F.struct(*(F.lit(0.0).alias(n) for n in ("x1", "y1", "x2", "y2")))
    return F.coalesce(bbox_of(real), zero)


def bone_vectors(joints: Column | str, parents: Sequence[int] = L.H36M_PARENTS) -> Column:
    """Each joint from its parent; the root's is 0."""
    return F.array(*(xyz(0.0, 0.0, 0.0) if p < 0 else minus(joint(joints, i), joint(joints, p)) for i, p in enumerate(parents)))


def bone_lengths(joints: Column | str, parents: Sequence[int] = L.H36M_PARENTS) -> Column:
    return F.transform(bone_vectors(joints, parents), length)


def length_variation(lengths: Column | str) -> tuple[Column, Column]:
    """(mean, coefficient of variation) aggregates over the positive finite lengths."""
    good = F.when((col(lengths) > 0) & ~F.isnan(col(lengths)), col(lengths))
    return F.avg(good), F.try_divide(F.stddev_pop(good), F.avg(good))


def points_mean(points: Column, least: int = 1) -> Column:
    """struct(p, valid): mean of the points, 0 with fewer than `least`."""
    n = F.size(points)
    mean = lambda a: F.try_divide(F.aggregate(points, F.lit(0.0), lambda s, p: s + p[a]), n)
    return F.when(n >= least, F.struct(xyz(mean("x"), mean("y"), mean("z")).alias("p"), F.lit(True).alias("valid"))).otherwise(F.struct(xyz(0.0, 0.0, 0.0).alias("p"), F.lit(False).alias("valid")))


def global_anchors(joints: Column | str, visible: Column | str, names: Sequence[str]) -> dict[str, Column]:
    """A0-A7 by name: structs of point and validity. A joint that the layout lacks is an error."""
    need = {n: L.required(names, n, n.title().replace("_", ""), f"{n[0]}_{n.split('_')[1]}") for n in ("left_wrist", "left_elbow", "left_shoulder", "right_shoulder", "left_hip", "right_hip")}
    seen = lambda i: F.get(col(visible), F.lit(i))
    group = lambda idx: F.filter(F.array(*(F.when(seen(i), joint(joints, i)) for i in idx)), lambda p: p.isNotNull())
    one = lambda i: F.struct(joint(joints, i).alias("p"), seen(i).alias("valid"))
    ls, rs = need["left_shoulder"], need["right_shoulder"]
    pelvis = L.index_of(names, "pelvis", "root", "hip")
    box = bbox_of(shown(joints, visible))
    centre = F.when(box.isNotNull(), xyz((box["x1"] + box["x2"]) / 2, (box["y1"] + box["y2"]) / 2, 0.0)).otherwise(xyz(0.0, 0.0, 0.0))
    return {
        "A0_left_wrist": one(need["left_wrist"]),
        "A1_left_elbow": one(need["left_elbow"]),
        "A2_left_shoulder": one(ls),
        "A3_shoulder_midpoint": points_mean(group([ls, rs]), 2),
        "A4_pelvis": points_mean(group([pelvis]), 1) if pelvis is not None else points_mean(group([need["left_hip"], need["right_hip"]]), 2),
        "A5_upper_centroid": points_mean(group([ls, rs, need["left_elbow"], need["left_wrist"]]), 2),
        "A6_full_centroid": points_mean(shown(joints, visible), 1),
        "A7_bbox_center": F.struct(centre.alias("p"), box.isNotNull().alias("valid")),
    }


def root_trajectory(mode: str, joints_m: Column | None, bbox: Column | None) -> Column:
    """Root point of a frame: 'root3d' from metre joints, 'center' from the box, 'full' box centre with its sides, 'auto' the first there is."""
    root = None if joints_m is None else joint(joints_m, 0)
    centre = None if bbox is None else xyz((bbox["x1"] + bbox["x2"]) / 2, (bbox["y1"] + bbox["y2"]) / 2, 0.0)
    if mode == "auto":
        return F.coalesce(*(c for c in (root, centre) if c is not None))
    if mode == "full":
        return F.struct(centre.alias("center"), (bbox["x2"] - bbox["x1"]).alias("width"), (bbox["y2"] - bbox["y1"]).alias("height"))
    return {"root3d": root, "center": centre}[mode]


def representation(joints: str, two_d: bool = False, external_visibility: bool = False) -> Column:
    """Aggregate over all frames of a sequence: what the third coordinate is."""
    z = F.transform(F.col(joints), lambda p: p["z"])
    zero = F.bool_and(F.forall(z, lambda v: F.abs(v) <= 1e-8))
    unit = F.bool_and(F.forall(z, lambda v: v.between(0, 1)))
    if two_d:
        return F.any_value(F.lit("2d_xy"))
    third = F.when(unit, "2d_xy_with_visibility_in_last_dim").otherwise("3d_xyz")
    return F.when(zero, "2d_xy_zero_z_with_external_visibility").otherwise(third) if external_visibility else third
