"""Thresholds and fixed values of the evidence engine."""

from __future__ import annotations

from dataclasses import dataclass

# Statuses, colours and formats that results carry.
NEUTRAL_COLORS = ("BLACK", "GREY", "SILVER", "WHITE")
COLOR_CLASSES = ("Black", "Blue", "Brown", "Grey", "Red", "Silver", "White", "Yellow")
COLOR_WORDS = (
    ("white", "White"), ("black", "Black"), ("grey", "Grey"), ("gray", "Grey"), ("nardo", "Grey"), ("gry", "Grey"), ("silver", "Silver"),
    ("red", "Red"), ("blue", "Blue"), ("brown", "Brown"), ("bronze", "Brown"), ("yellow", "Yellow"), ("gold", "Yellow"),
)
PLATE = r"^[0-9]{2}[A-Z]{1,2}[0-9]{4,6}\z"
LOCK_PLATE = r"^[0-9]{2}[A-Z]{1,2}[0-9]{5,6}\z"
SESSION_ID = r"^[A-Za-z0-9_-]{8,64}\z"
SOURCE_TYPES, SPLITS = ("real", "synthetic", "pseudo"), ("train", "val", "test")
BANDS = ("0.0-0.1", "0.1-0.2", "0.2-0.3", "0.3-0.4", "0.4-0.5", "0.5-0.6", "0.6-0.7", "0.7-0.8", "0.8-0.9", "0.9-1.0", "1.0")
VEHICLE_CLASSES = (2, 5, 7)


@dataclass(frozen=True)
class Params:
    """Defaults are those of the deployed configuration."""

    color_warn_conf: float = 0.40
    neutral: tuple[str, ...] = NEUTRAL_COLORS
    lock_conf: float = 0.50
    lock_repeat: int = 2
    soft_conf: float = 0.40
    single_lock_conf: float = 0.85
    collect_frames: int = 10
    max_collect_frames: int = 50
    max_ready_samples: int = 300
    min_persist_frames: int = 3
    min_area_ratio: float = 0.10
    roi: tuple[float, float, float, float] = (0.20, 0.20, 0.80, 1.0)
    frozen_exact: float = 0.90
    expanded_exact: float = 0.90
    max_cer: float = 0.031


DEFAULTS = Params()
