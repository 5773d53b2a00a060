"""Skeleton constants: bones, parents, drawn edges, mirrored pairs."""

from __future__ import annotations

# Bones of the 15-bone rig in feature order, and the root that the 16-bone order puts first.
ROOT = "HumanoidRootPart"
BONES = ("LowerTorso", "UpperTorso", "Head", "LeftUpperArm", "LeftLowerArm", "LeftHand", "RightUpperArm", "RightLowerArm",
         "RightHand", "LeftUpperLeg", "LeftLowerLeg", "LeftFoot", "RightUpperLeg", "RightLowerLeg", "RightFoot")
# Parent bone by bone, and drawn edges between positions in BONES.
PARENTS = {
    "LowerTorso": ROOT, "UpperTorso": "LowerTorso", "Head": "UpperTorso", "LeftUpperArm": "UpperTorso",
    "LeftLowerArm": "LeftUpperArm", "LeftHand": "LeftLowerArm", "RightUpperArm": "UpperTorso", "RightLowerArm": "RightUpperArm",
    "RightHand": "RightLowerArm", "LeftUpperLeg": "LowerTorso", "LeftLowerLeg": "LeftUpperLeg", "LeftFoot": "LeftLowerLeg",
    "RightUpperLeg": "LowerTorso", "RightLowerLeg": "RightUpperLeg", "RightFoot": "RightLowerLeg",
}
EDGES = ((0, 1), (1, 2), (1, 3), (3, 4), (4, 5), (1, 6), (6, 7), (7, 8), (0, 9), (9, 10), (10, 11), (0, 12), (12, 13), (13, 14))
# Bones that change places in a mirror, and numbers of a bone in a frame.
MIRROR_PAIRS = "3:6,4:7,5:8,9:12,10:13,11:14"
FEATURES_PER_BONE = 6
BONES_WITH_ROOT = (ROOT, *BONES)
