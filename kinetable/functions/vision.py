"""Column functions on landmarks, pose, expression channels and quality scores."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinetable.anatomy import CHANNELS, mirror_index
from kinetable.config import Config

Channel = Callable[[str], Column]


def channels(values: Column | str, names: Sequence[str] = CHANNELS) -> Channel:
    """Look a channel up by name in an array; absent channels read 0."""
    column = F.col(values) if isinstance(values, str) else values
    where = {name: i for i, name in enumerate(names)}

    def get(name: str) -> Column:
        if name not in where:
            return F.lit(0.0)
        return F.coalesce(F.get(column, F.lit(where[name])).cast("double"), F.lit(0.0))

    return get


def _both(get: Channel, stem: str) -> Column:
    return (get(stem + "Left") + get(stem + "Right")) * 0.5


def _unit(value: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))


def matrix_to_euler(m: Column) -> Column:
    """Pitch, yaw, roll in degrees (2 digits) and translation (3 digits) of a flat 4x4 matrix."""
    r00, r10, r20, r21, r22, r12, r11 = (m[i] for i in (0, 4, 8, 9, 10, 6, 5))
    sy = F.sqrt(r00 * r00 + r10 * r10)
    flat = sy < 1e-6
    pitch = F.when(flat, F.atan2(-r12, r11)).otherwise(F.atan2(r21, r22))
    roll = F.when(flat, F.lit(0.0)).otherwise(F.atan2(r10, r00))
    return F.struct(
        F.bround(F.degrees(pitch), 2).alias("pitch"),
        F.bround(F.degrees(F.atan2(-r20, sy)), 2).alias("yaw"),
        F.bround(F.degrees(roll), 2).alias("roll"),
        F.bround(m[3], 3).alias("tx"),
        F.bround(m[7], 3).alias("ty"),
        F.bround(m[11], 3).alias("tz"),
    )


def euler_to_matrix(pitch: Column, yaw: Column, roll: Column) -> Column:
    """Flat 3x3 rotation Rz(roll) Ry(yaw) Rx(pitch), angles in degrees."""
    a, b, c = F.radians(pitch), F.radians(yaw), F.radians(roll)
    sa, ca, sb, cb, sc, cc = F.sin(a), F.cos(a), F.sin(b), F.cos(b), F.sin(c), F.cos(c)
    return F.array(
        cc * cb, cc * sb * sa - sc * ca, cc * sb * ca + sc * sa,
        sc * cb, sc * sb * sa + cc * ca, sc * sb * ca - cc * sa,
        -sb, cb * sa, cb * ca,
    )


def bbox(landmarks: Column, width: Column, height: Column) -> Column:
    """Pixel box of flat x,y,z landmarks with its centre and area share of the image."""
    points = F.sequence(F.lit(0), (F.size(landmarks) / 3).cast("int") - 1)
    xs = F.transform(points, lambda i: F.get(landmarks, i * 3).cast("double") * width)
    ys = F.transform(points, lambda i: F.get(landmarks, i * 3 + 1).cast("double") * height)
    x0 = F.greatest(F.lit(0), F.array_min(xs).cast("int"))
    y0 = F.greatest(F.lit(0), F.array_min(ys).cast("int"))
    w = F.greatest(F.lit(1), F.least(width, F.array_max(xs).cast("int")) - x0)
    h = F.greatest(F.lit(1), F.least(height, F.array_max(ys).cast("int")) - y0)
    return F.struct(
        x0.alias("x"), y0.alias("y"), w.alias("w"), h.alias("h"),
        ((x0 + w / 2.0) / width).alias("cx"), ((y0 + h / 2.0) / height).alias("cy"),
        (w * h / F.greatest(F.lit(1), width * height)).alias("area"),
    )


def pose_quality(pitch: Column, yaw: Column, roll: Column, cfg: Config) -> Column:
    def share(angle, limit):
        return F.greatest(F.lit(0.0), 1.0 - F.abs(angle) / max(1.0, limit))

    return share(yaw, cfg.max_yaw_deg) * 0.5 + share(pitch, cfg.max_pitch_deg) * 0.3 + share(roll, cfg.max_roll_deg) * 0.2


def composite_score(confidence: Column, area: Column, blur: Column, pose: Column, jitter: Column) -> Column:
    return (
        confidence * 0.25
        + F.least(F.lit(1.0), area / 0.15) * 0.20
        + F.least(F.lit(1.0), blur / 150.0) * 0.20
        + pose * 0.20
        + F.greatest(F.lit(0.0), 1.0 - F.least(F.lit(1.0), jitter / 1.5)) * 0.15
    )


def rounded_quality(score: Column, blur: Column, area: Column, pose: Column, jitter: Column) -> Column:
    """The quality numbers as stored: 4, 2, 4, 4 and 4 digits."""
    digits = {"score": (score, 4), "blur": (blur, 2), "area_ratio": (area, 4), "pose_quality": (pose, 4), "jitter": (jitter, 4)}
    return F.struct(*[F.bround(c, d).alias(n) for n, (c, d) in digits.items()])


def rejection_reason(
    w: Column, h: Column, area: Column, blur: Column, pitch: Column, yaw: Column, jitter: Column, confidence: Column, cfg: Config
) -> Column:
    """First failed check as text, null if all pass."""
    small = (w < cfg.min_width_px) | (h < cfg.min_height_px) | (area < cfg.min_area_ratio)
    turned = (F.abs(yaw) > cfg.max_yaw_deg) | (F.abs(pitch) > cfg.max_pitch_deg)
    return (
        F.when(small, F.format_string("face_too_small (%dx%dpx, area %.3f)", w, h, F.bround(area, 3)))
        .when(blur < cfg.min_blur, F.format_string(f"motion_blur (laplacian %.1f < {cfg.min_blur})", F.bround(blur, 1)))
        .when(turned, F.format_string("extreme_pose (yaw=%.1f, pitch=%.1f)", F.bround(yaw, 1), F.bround(pitch, 1)))
        .when(jitter > cfg.max_jitter, F.format_string("tracking_jitter (velocity %.2f)", F.bround(jitter, 2)))
        .when(confidence < cfg.min_confidence, F.format_string("low_confidence (%.2f)", F.bround(confidence, 2)))
    )


def point_distance2(landmarks: Column, a: int, b: int) -> Column:
    dx = landmarks[a * 3] - landmarks[b * 3]
    dy = landmarks[a * 3 + 1] - landmarks[b * 3 + 1]
    return F.sqrt(dx * dx + dy * dy)


def mouth_activation(get: Channel, landmarks: Column | None = None) -> Column:
    """Pose-invariant mouth opening from channels and, if given, lip landmarks."""
    jaw = get("jawOpen")
    aperture = jaw
    if landmarks is not None:
        face = point_distance2(landmarks, 10, 152)
        aperture = F.when(face > 1e-4, point_distance2(landmarks, 13, 14) / face).otherwise(jaw)
    stretch = get("mouthStretchLeft") + get("mouthStretchRight")
    return jaw * 0.60 + aperture * 1.40 + get("mouthPucker") * 0.25 + stretch * 0.15


def dental_features(get: Channel) -> Column:
    """Upper teeth, lower teeth, gap and state id as a 4-value array."""
    jaw, close = get("jawOpen"), get("mouthClose")
    raised, lowered, smile = _both(get, "mouthUpperUp"), _both(get, "mouthLowerDown"), _both(get, "mouthSmile")
    upper = _unit(raised * 1.5 + smile * 0.4)
    lower = _unit(lowered * 1.6 + jaw * 0.5)
    gap = _unit(jaw * 1.2 - close * 0.8)
    # 0 occluded, 1 labiodental, 2 dental, 3 open vowel, 4 smile, 5 neutral.
    state = (
        F.when((close > 0.35) | ((jaw < 0.06) & (raised < 0.08)), 0.0)
        .when((lowered > 0.25) & (upper > 0.15) & (jaw < 0.25), 1.0)
        .when(((upper > 0.20) | (lower > 0.20)) & (jaw < 0.35), 2.0)
        .when(jaw >= 0.35, 3.0)
        .when(smile > 0.30, 4.0)
        .otherwise(5.0)
    )
    return F.array(upper, lower, gap, state)


def dental_class(get: Channel) -> Column:
    """Live variant of the dental state as text."""
    jaw = get("jawOpen")

    def larger(stem):
        return F.greatest(get(stem + "Left"), get(stem + "Right"))

    upper = F.least(F.lit(1.0), larger("mouthUpperUp") * 1.5 + larger("mouthSmile") * 0.4)
    lower = F.least(F.lit(1.0), larger("mouthLowerDown") * 1.6 + jaw * 0.3)
    # Class texts.
    return (
        F.when((jaw < 0.04) & (F.greatest(upper, lower) < 0.12), "TEETH OCCLUDED /P,B,M/")
        .when((upper > 0.32) & (jaw < 0.20) & (lower < 0.25), "LABIODENTAL /F,V/")
        .when((jaw < 0.22) & ((upper > 0.22) | (lower > 0.22)), "DENTAL /S,Z,TH/")
        .when(jaw >= 0.22, "OPEN VOWEL /AA,AH/")
        .otherwise("SMILE TEETH SHOW")
    )


def emotion_id(get: Channel) -> Column:
    """0 neutral, 1 happy, 2 angry, 3 scared or surprised, 4 sad; earlier tests win."""
    smile, brow, wide = _both(get, "mouthSmile"), _both(get, "browDown"), _both(get, "eyeWide")
    inner = get("browInnerUp")
    angry = ((brow > 0.35) & (_both(get, "noseSneer") > 0.20)) | ((brow > 0.45) & (_both(get, "mouthPress") > 0.25))
    scared = ((inner > 0.45) & (wide > 0.30)) | (wide > 0.50)
    happy = (smile > 0.30) & ((_both(get, "cheekSquint") > 0.15) | (smile > 0.45))
    sad = (_both(get, "mouthFrown") > 0.30) | ((get("mouthShrugLower") > 0.35) & (inner > 0.25))
    return F.when(angry, 2).when(scared, 3).when(happy, 1).when(sad, 4).otherwise(0)


def gaze(get: Channel) -> Column:
    """Horizontal and vertical gaze and its description."""
    x = ((get("eyeLookOutLeft") - get("eyeLookInLeft")) + (get("eyeLookInRight") - get("eyeLookOutRight"))) / 2.0
    y = ((get("eyeLookDownLeft") - get("eyeLookUpLeft")) + (get("eyeLookDownRight") - get("eyeLookUpRight"))) / 2.0
    # Gaze texts.
    text = (
        F.when((F.abs(x) < 0.10) & (F.abs(y) < 0.10), "FORWARD (CAMERA)")
        .when((F.abs(x) >= F.abs(y)) & (x < 0), "LOOKING LEFT")
        .when(F.abs(x) >= F.abs(y), "LOOKING RIGHT")
        .when(y < 0, "LOOKING UP")
        .otherwise("LOOKING DOWN")
    )
    return F.struct(x.alias("x"), y.alias("y"), text.alias("gaze"))


def flip(landmarks: Column, points: int) -> Column:
    """Mirror flat x,y,z landmarks: negate x, swap left and right points."""
    where = F.array(*[F.lit(i) for i in mirror_index(points)])
    return F.transform(
        F.sequence(F.lit(0), F.lit(points * 3 - 1)),
        lambda k: F.get(landmarks, F.get(where, (k / 3).cast("int")) * 3 + k % 3) * F.when(k % 3 == 0, -1.0).otherwise(1.0),
    )


def decompose(landmarks: Column, points: int) -> Column:
    """Symmetric half-sum and asymmetric half-difference with the mirror image."""
    mirrored = flip(landmarks, points)
    return F.struct(
        F.zip_with(landmarks, mirrored, lambda a, b: (a + b) * 0.5).alias("symmetric"),
        F.zip_with(landmarks, mirrored, lambda a, b: (a - b) * 0.5).alias("residual"),
    )


def to_ns(seconds: Column) -> Column:
    return (seconds * 1e9).cast("long")
