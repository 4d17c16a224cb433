"""Constants of the engine, and the check of a user's own configuration.

Values are read once on the driver and become literals of the plan.
"""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

# Labels, soiling ratios, defaults, ranges and thresholds.
LABELS = ("Clean", "Dusty", "Bird-Drop", "Electrical-Damage", "Physical-Damage", "Hotspot")
SOILING = {
    "Clean": 1.00,
    "Dusty": 0.92,
    "Bird-Drop": 0.88,
    "Electrical-Damage": 0.80,
    "Physical-Damage": 0.75,
    "Hotspot": 0.70,
}
WEATHER_DEFAULTS = {
    "ambient_temp_c": 25.0,
    "humidity_pct": 50.0,
    "wind_speed_ms": 2.0,
    "cloud_cover_pct": 0.0,
    "pressure_hpa": 1013.25,
    "latitude": 0.0,
    "longitude": 0.0,
}
MODEL_COLUMNS = (
    "irradiance_wm2",
    "module_temp_c",
    "ambient_temp_c",
    "humidity_pct",
    "wind_speed_ms",
    "cloud_cover_pct",
    "soiling_ratio",
    "fault_class_id",
    "detection_confidence",
)
DERIVED_COLUMNS = ("temperature_difference_c", "cloud_factor", "wind_cooling_factor")
FEATURE_RANGES = {
    "irradiance_wm2": (0.0, 1500.0),
    "module_temp_c": (-40.0, 120.0),
    "ambient_temp_c": (-40.0, 60.0),
    "humidity_pct": (0.0, 100.0),
    "wind_speed_ms": (0.0, 60.0),
    "cloud_cover_pct": (0.0, 100.0),
    "soiling_ratio": (0.0, 1.0),
    "fault_class_id": (0.0, 10.0),
    "detection_confidence": (0.0, 1.0),
    "temperature_difference_c": (-40.0, 100.0),
    "cloud_factor": (0.0, 1.0),
    "wind_cooling_factor": (0.0, 50.0),
}
ARTIFACTS = {
    "yolo": "weights/yolo_solar.pt",
    "mobilenet": "weights/mobilenet_solar.pth",
    "xgboost": "weights/xgboost_solar.joblib",
}
MOUNT_TYPES = ("rooftop", "ground-mount", "carport", "floating")
#: ImageNet channel means and deviations.
IMAGE_MEAN = (0.485, 0.456, 0.406)
IMAGE_STD = (0.229, 0.224, 0.225)


@dataclass(frozen=True)
class Settings:
    max_irradiance_wm2: float = 1000.0
    noct_celsius: float = 45.0
    noct_irradiance_ref: float = 800.0
    noct_ambient_ref: float = 20.0
    wind_cooling_coefficient: float = 1.5
    temp_coefficient_pmax: float = -0.004
    stc_temperature: float = 25.0
    panel_rated_power_wp: float = 400.0
    loss_critical_pct: float = 20.0
    loss_warning_pct: float = 10.0
    hot_module_c: float = 65.0
    low_irradiance_wm2: float = 50.0
    default_city: str = "Chennai"
    detector_size: int = 640
    detector_confidence: float = 0.45
    detector_iou: float = 0.50
    classifier_size: int = 224
    labels: tuple[str, ...] = LABELS
    soiling: Mapping[str, float] = field(default_factory=lambda: dict(SOILING))
    weather_defaults: Mapping[str, float] = field(default_factory=lambda: dict(WEATHER_DEFAULTS))
    model_columns: tuple[str, ...] = MODEL_COLUMNS


DEFAULT = Settings()

#: section: required keys and the inclusive range of those that are checked as numbers.
_RULES: dict[str, dict[str, tuple | None]] = {
    "weather": {"base_url": None, "timeout_seconds": (1, 300), "default_city": None, "units": None, "defaults": None},
    "weather.defaults": {
        "ambient_temp_c": None, "humidity_pct": (0, 100), "wind_speed_ms": (0, None), "cloud_cover_pct": (0, 100),
        "pressure_hpa": None, "latitude": (-90, 90), "longitude": (-180, 180),
    },
    "models": {"yolo": None, "mobilenet": None, "xgboost": None},
    "models.yolo": {"weights": None, "confidence_threshold": (0, 1), "iou_threshold": (0, 1), "image_size": (1, None)},
    "models.mobilenet": {"weights": None, "num_classes": (1, None), "input_size": (1, None)},
    "models.xgboost": {"weights": None},
    "classification": {"labels": None},
    "physics": {
        "max_irradiance_wm2": (0, None), "irradiance_cloud_factor": (0, 1), "noct_celsius": None,
        "noct_irradiance_ref": (1, None), "noct_ambient_ref": None, "wind_cooling_coefficient": None,
        "temp_coefficient_pmax": None, "stc_temperature": None, "soiling_ratios": None, "panel_rated_power_wp": (0, None),
    },
    "feature_engineering": {"feature_columns": None},
    "recommendations": {
        "efficiency_loss_critical_pct": (0, 100), "efficiency_loss_warning_pct": (0, 100), "hotspot_max_temp_c": None,
        "cleaning_humidity_threshold_pct": (0, 100),
    },
    "logging": {"level": None, "format": None},
}
_NOT_BLANK = ("weather.base_url", "weather.default_city")
_NOT_EMPTY = {"classification.labels": list, "physics.soiling_ratios": dict, "feature_engineering.feature_columns": list}


def config_problems(config: Any) -> list[str]:
    """What is wrong with a configuration, in the order of its sections; empty if nothing is.

    Numbers may not be booleans. NaN passes the range checks, as all its comparisons are false.
    """
    if not isinstance(config, Mapping):
        return ["the configuration's root must be a mapping"]
    absent = [s for s in _RULES if "." not in s and s not in config]
    if absent:
        return [f"missing sections: {absent}"]
    found: list[str] = []
    for section, keys in _RULES.items():
        node: Any = config
        for name in section.split("."):
            node = node.get(name) if isinstance(node, Mapping) else None
        if not isinstance(node, Mapping):
            found.append(f"'{section}' must be a mapping")
            continue
        if missing := [k for k in keys if k not in node]:
            found.append(f"'{section}' lacks {missing}")
        for key, limits in keys.items():
            if key not in node:
                continue
            name, value = f"{section}.{key}", node[key]
            if limits is not None:
                low, high = limits
                if isinstance(value, bool) or not isinstance(value, (int, float)):
                    found.append(f"'{name}' must be a number")
                elif (low is not None and value < low) or (high is not None and value > high):
                    found.append(f"'{name}' is {value}, outside [{low}, {high}]")
            elif name in _NOT_BLANK and not str(value).strip():
                found.append(f"'{name}' must not be blank")
            elif name in _NOT_EMPTY and (not isinstance(value, _NOT_EMPTY[name]) or not value):
                found.append(f"'{name}' must be a non-empty {_NOT_EMPTY[name].__name__}")
            elif name == "feature_engineering.feature_columns" and not all(isinstance(c, str) and c.strip() for c in value):
                found.append(f"'{name}' must hold non-empty strings only")
    return found


def load_settings(path: str | Path) -> Settings:
    """Settings from a YAML (if PyYAML is there) or JSON file; ValueError names the first problem."""
    text = Path(path).read_text(encoding="utf-8")
    if str(path).endswith(".json"):
        import json

        config = json.loads(text)
    else:
        import yaml

        config = yaml.safe_load(text)
    if problems := config_problems(config):
        raise ValueError(problems[0])
    physics, advice = config["physics"], config["recommendations"]
    return Settings(
        **{k: float(physics[k]) for k in (
            "max_irradiance_wm2", "noct_celsius", "noct_irradiance_ref", "noct_ambient_ref", "wind_cooling_coefficient",
            "temp_coefficient_pmax", "stc_temperature", "panel_rated_power_wp",
        )},
        loss_critical_pct=float(advice["efficiency_loss_critical_pct"]),
        loss_warning_pct=float(advice["efficiency_loss_warning_pct"]),
        hot_module_c=float(advice["hotspot_max_temp_c"]),
        default_city=config["weather"]["default_city"],
        detector_size=int(config["models"]["yolo"]["image_size"]),
        classifier_size=int(config["models"]["mobilenet"]["input_size"]),
        labels=tuple(config["classification"]["labels"]),
        soiling={k: float(v) for k, v in physics["soiling_ratios"].items()},
        weather_defaults={k: float(config["weather"]["defaults"][k]) for k in WEATHER_DEFAULTS},
        model_columns=tuple(config["feature_engineering"]["feature_columns"]),
    )


def secret(key: str, first: Mapping[str, str] | None = None, fallback: str | None = None) -> str | None:
    """From ``first`` (a secrets store), then the environment, then the fallback; an empty string counts as missing."""
    return (first or {}).get(key) or os.environ.get(key) or fallback
