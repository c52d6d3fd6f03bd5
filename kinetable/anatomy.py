"""Channel names, landmark groups, mirror pairs, template points."""

from __future__ import annotations

LANDMARKS = 478

# The 52 expression channel names in their standard order.
CHANNELS = (
    "eyeBlinkLeft", "eyeLookDownLeft", "eyeLookInLeft", "eyeLookOutLeft", "eyeLookUpLeft", "eyeSquintLeft", "eyeWideLeft",
    "eyeBlinkRight", "eyeLookDownRight", "eyeLookInRight", "eyeLookOutRight", "eyeLookUpRight", "eyeSquintRight", "eyeWideRight",
    "jawForward", "jawLeft", "jawRight", "jawOpen",
    "mouthClose", "mouthFunnel", "mouthPucker", "mouthLeft", "mouthRight",
    "mouthSmileLeft", "mouthSmileRight", "mouthFrownLeft", "mouthFrownRight",
    "mouthDimpleLeft", "mouthDimpleRight", "mouthStretchLeft", "mouthStretchRight",
    "mouthRollLower", "mouthRollUpper", "mouthShrugLower", "mouthShrugUpper",
    "mouthPressLeft", "mouthPressRight", "mouthLowerDownLeft", "mouthLowerDownRight",
    "mouthUpperUpLeft", "mouthUpperUpRight",
    "browDownLeft", "browDownRight", "browInnerUp", "browOuterUpLeft", "browOuterUpRight",
    "cheekPuff", "cheekSquintLeft", "cheekSquintRight",
    "noseSneerLeft", "noseSneerRight", "tongueOut",
)

# Landmarks that speech does not move (alignment anchors).
ANCHORS = (168, 6, 197, 133, 362, 33, 263, 10, 151, 9, 234, 454)

# Landmarks whose displacement measures jitter.
JITTER_POINTS = (1, 33, 263, 61, 291)

# Landmark groups scaled together during normalization.
LIPS = (
    61, 185, 40, 39, 37, 0, 267, 269, 270, 409, 291,
    146, 91, 181, 84, 17, 314, 405, 321, 375,
    78, 191, 80, 81, 82, 13, 312, 311, 310, 415, 308,
    95, 88, 178, 87, 14, 317, 402, 318, 324,
)
NOSE = (168, 6, 197, 195, 5, 4, 1, 19, 94, 2, 98, 97, 326, 327)
EYES = (
    33, 160, 158, 133, 153, 144, 468, 469, 470, 471, 472,
    362, 385, 387, 263, 373, 380, 473, 474, 475, 476, 477,
)

# End points of the three body measures (mouth, pupils, nose).
MOUTH_SPAN = (61, 291)
PUPIL_SPAN = (468, 473)
NOSE_SPAN = (168, 2)

# Landmarks on the symmetry plane.
MIDLINE = (
    10, 151, 9, 8, 168, 6, 197, 195, 5, 4, 1, 19, 94, 2,
    0, 11, 12, 13, 14, 15, 16, 17, 18, 200, 199, 175, 152,
)

# left/right landmark pairs.
MIRROR_PAIRS = (
    (33, 263), (133, 362), (160, 385), (158, 387), (153, 373), (144, 380),
    (159, 386), (145, 374), (246, 466), (7, 249),
    (468, 473), (469, 474), (470, 475), (471, 476), (472, 477),
    (70, 300), (63, 293), (105, 334), (66, 296), (107, 336),
    (55, 285), (65, 295), (52, 282), (53, 283), (46, 276),
    (61, 291), (185, 409), (40, 270), (39, 269), (37, 267),
    (146, 375), (91, 321), (181, 405), (84, 314),
    (78, 308), (191, 415), (80, 310), (81, 311), (82, 312),
    (95, 324), (88, 318), (178, 402), (87, 317),
    (98, 327), (97, 326), (129, 358), (203, 423),
    (116, 345), (123, 352), (147, 376), (213, 433), (138, 367),
    (234, 454), (127, 356), (93, 323), (132, 361), (58, 288),
    (172, 397), (136, 365), (149, 378), (150, 379), (176, 400),
    (21, 251), (54, 284), (103, 332), (67, 297), (109, 338),
)

# Known points of the reference face; all others start at the origin.
TEMPLATE_POINTS = {
    468: (-0.50, 0.00, 0.00), 473: (0.50, 0.00, 0.00), 168: (0.00, 0.00, 0.00),
    133: (-0.25, 0.00, 0.02), 362: (0.25, 0.00, 0.02), 33: (-0.60, 0.00, -0.05), 263: (0.60, 0.00, -0.05),
    6: (0.00, 0.15, 0.04), 197: (0.00, 0.30, 0.08), 1: (0.00, 0.55, 0.22), 2: (0.00, 0.70, 0.12),
    98: (-0.20, 0.60, 0.08), 327: (0.20, 0.60, 0.08),
    61: (-0.38, 0.95, 0.06), 291: (0.38, 0.95, 0.06),
    0: (0.00, 0.88, 0.14), 17: (0.00, 1.05, 0.12), 13: (0.00, 0.93, 0.10), 14: (0.00, 0.98, 0.09),
    152: (0.00, 1.45, 0.04),
    9: (0.00, -0.15, -0.01), 151: (0.00, -0.30, -0.03), 10: (0.00, -0.65, -0.08),
    234: (-0.95, -0.05, -0.45), 454: (0.95, -0.05, -0.45),
}

# Words that disqualify a candidate title (strict list first, extras for the second search).
EXCLUDED_WORDS = (
    "music", "song", "remix", "beat", "cover", "trailer", "soundtrack",
    "bgm", "instrumental", "asmr", "meditation", "ambient", "compilation",
    "shorts", "karaoke", "lofi", "chill",
)
EXTRA_EXCLUDED_WORDS = ("reaction", "gaming", "unboxing")

# Enumerations.
LEVELS = (0, 1, 2, 3, 4)
LEVEL_NAMES = (
    "LEVEL_0_DETECTED", "LEVEL_1_TRACKABLE", "LEVEL_2_GEOMETRICALLY_USABLE",
    "LEVEL_3_ANIMATION_QUALITY", "LEVEL_4_SPEAKER_PAIRED",
)
ROLES = ("SPEAKER", "SPEAKER_PAUSE", "LISTENER", "UNKNOWN")


def mirror_index(size: int = LANDMARKS) -> list[int]:
    """Position each landmark takes after swapping left and right."""
    swapped = {}
    for left, right in MIRROR_PAIRS:
        if max(left, right) < size:
            swapped[left], swapped[right] = right, left
    return [swapped.get(i, i) for i in range(size)]


def channel_weights() -> list[float]:
    """Loss weight of each channel: rest .5, eyes 1.2, brows/cheeks/nose 2, speech 4."""
    # Channel groups by position.
    eyes = {0, 5, 6, 7, 12, 13}
    expressive = range(41, 51)
    speech = set(range(14, 41)) | {51}
    return [
        4.0 if i in speech else 2.0 if i in expressive else 1.2 if i in eyes else 0.5
        for i in range(len(CHANNELS))
    ]
