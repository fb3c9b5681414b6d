"""Joint layouts and sensor channels."""

# Joint names and their order, bone parents, sensor order, channel names.
COCO17 = ("nose", "left_eye", "right_eye", "left_ear", "right_ear", "left_shoulder", "right_shoulder", "left_elbow", "right_elbow", "left_wrist", "right_wrist", "left_hip", "right_hip", "left_knee", "right_knee", "left_ankle", "right_ankle")
H36M17 = ("pelvis", "right_hip", "right_knee", "right_ankle", "left_hip", "left_knee", "left_ankle", "spine", "thorax", "neck", "head", "left_shoulder", "left_elbow", "left_wrist", "right_shoulder", "right_elbow", "right_wrist")
H36M_PARENTS = (-1, 0, 1, 2, 0, 4, 5, 0, 7, 8, 9, 8, 11, 12, 8, 14, 15)
# Where the H36M joints are among 25 body points, and their names in motion capture.
SMPLX25 = {"pelvis": 0, "left_hip": 1, "right_hip": 2, "left_knee": 3, "right_knee": 4, "left_ankle": 5, "right_ankle": 6, "left_shoulder": 8, "right_shoulder": 9, "left_elbow": 10, "right_elbow": 11, "left_wrist": 12, "right_wrist": 13}
CAPTURE21 = ("Hips", "RightUpLeg", "RightLeg", "RightFoot", "LeftUpLeg", "LeftLeg", "LeftFoot", "Spine2", "Spine3", "Neck", "Head", "LeftShoulder", "LeftArm", "LeftForeArm", "RightShoulder", "RightArm", "RightForeArm")
PROTECTED = (0, 7, 8, 9, 10)
DISTAL = (2, 3, 5, 6, 12, 13, 15, 16)
ACC = ("acc_x", "acc_y", "acc_z")
QUAT = ("quat_w", "quat_x", "quat_y", "quat_z")
GYRO = ("gyro_x", "gyro_y", "gyro_z")
CANONICAL7 = ACC + QUAT


def squash(name: str) -> str:
    """Lower-case letters and digits of a joint or channel name."""
    return "".join(c for c in name.strip().lower() if c.isalnum())


def index_of(names, *candidates: str) -> int | None:
    places = {squash(n): i for i, n in enumerate(names)}
    return next((places[squash(c)] for c in candidates if squash(c) in places), None)


def required(names, *candidates: str) -> int:
    found = index_of(names, *candidates)
    if found is None:
        raise ValueError(f"the layout lacks {candidates[0]}; it has {list(names)}")
    return found
