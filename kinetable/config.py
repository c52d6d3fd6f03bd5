"""Thresholds used by the operators.

Times are written in seconds and multiplied by ``unit`` before they meet a time
column, so the same operator runs on float seconds (``unit=1.0``) and on integer
microseconds of any scale (for example one day per second).
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """Fixed default thresholds; every one can be overridden."""

    unit: float = 1.0

    # face size, sharpness and pose limits
    min_width_px: int = 70
    min_height_px: int = 70
    min_area_ratio: float = 0.025
    min_confidence: float = 0.35
    min_blur: float = 35.0
    max_yaw_deg: float = 50.0
    max_pitch_deg: float = 40.0
    max_roll_deg: float = 35.0
    max_jitter: float = 1.2

    # lip motion and the speech gate
    lip_velocity: float = 0.16
    lip_range: float = 0.012
    lip_peak: float = 0.018
    lip_window_s: float = 0.40
    lip_window_rows: int = 30
    syllable_hold_s: float = 0.25
    word_hold_s: float = 0.55
    pause_limit_s: float = 1.80
    strict_single_face: bool = True

    # voice activity
    vad_energy: float = 0.008
    vad_floor_start: float = 0.004
    vad_hangover_s: float = 0.38

    # hysteresis
    quality_enter: float = 0.65
    quality_exit: float = 0.50
    quality_min_s: float = 0.15
    watch_trigger_s: float = 0.30
    watch_loss_s: float = 1.80

    # One Euro smoothing
    min_cutoff: float = 1.0
    beta: float = 0.007
    d_cutoff: float = 1.0

    # capture
    fps: int = 30
    preroll_s: float = 2.0
    gap_s: float = 0.055

    # tracking
    track_max_missed: int = 15
    track_max_distance: float = 0.30

    # extent of one work slice of a session, in seconds of session time
    slice_s: float = 600.0

    def span(self, seconds: float):
        """``seconds`` expressed in the unit of the time column."""
        value = seconds * self.unit
        return value if self.unit == 1.0 else int(round(value))
