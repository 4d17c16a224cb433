"""Kinds of errors: exceptions where a plan can't be made, names and prefixes of messages where a row fails."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How the message of each kind begins; {0} is the model or the city.
PREFIXES = {
    "ModelLoadError": "[{0}] Model load failed: ",
    "PredictionError": "[{0}] Prediction failed: ",
    "InputValidationError": "Input validation failed: ",
    "ImageValidationError": "Image validation failed: ",
    "FeatureValidationError": "Feature validation failed: ",
    "WeatherAPIError": "Weather API error for city '{0}': ",
    "UnexpectedError": "",
}


class FleetError(Exception):
    """Base of all of them; ``subject`` is the model or the city, where there is one."""

    def __init__(self, reason: str, subject: str = ""):
        self.reason, self.subject = reason, subject
        super().__init__(PREFIXES.get(type(self).__name__, "").format(subject) + reason)

    def __reduce__(self):
        return type(self), (self.reason, self.subject)


class ModelLoadError(FleetError):
    """A model isn't there, or can't be read."""


class PredictionError(FleetError):
    """A model was loaded, but fails on what it is given."""


class InputValidationError(FleetError):
    """A scalar input is missing, of the wrong type or out of range."""


class ImageValidationError(FleetError):
    """There is no image, or it can't be decoded."""


class FeatureValidationError(FleetError):
    """A feature is missing or out of range."""


class WeatherAPIError(FleetError):
    """The weather of a city can't be had, and no defaults are wanted."""


def message(kind: str, reason: Column, subject: str = "") -> Column:
    """The text of an error of ``kind`` in a row; null if ``reason`` is null."""
    return F.concat(F.lit(PREFIXES[kind].format(subject)), reason)
