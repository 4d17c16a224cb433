"""The whole run as one plan: checks, physics, features, prediction, advice, and where a run failed.

Stages stand in the order image, inputs, detect, classify, weather, features, predict, recommend.
The first failing stage decides; what earlier stages gave stays, later columns have their defaults.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.errors import message as error_text
from panelwright.functions.plan import settled
from panelwright.functions.text import default_if_empty
from panelwright.operators.features import RAW_COLUMNS, feature_error, validated, with_features
from panelwright.operators.inputs import input_error
from panelwright.operators.physics import observed_at, with_physics
from panelwright.operators.prediction import surrogate_loss, with_prediction
from panelwright.operators.regression import with_saved_model
from panelwright.operators.rules import NO_ACTION, with_report
from panelwright.settings import DEFAULT, Settings

STAGES = ("image", "inputs", "detect", "classify", "weather", "features", "predict", "none")
#: Kind of error of a stage, and the model it is about.
KINDS = {
    "image": ("ImageValidationError", ""),
    "inputs": ("InputValidationError", ""),
    "detect": ("PredictionError", "YOLO"),
    "classify": ("PredictionError", "MobileNet"),
    "weather": ("UnexpectedError", ""),
    "features": ("FeatureValidationError", ""),
    "predict": ("PredictionError", "XGBoost"),
}
# Fixed value: what is said of an error of no known kind.
GENERIC = "An unexpected error occurred while analysing the image. Please try again; if the problem persists, check the logs."
#: What columns hold if the stage that makes them wasn't reached.
UNREACHED = {
    "detect": {"detection_confidence": 0.0},
    "classify": {"label": "Unknown"},
    "weather": {"ambient_temp_c": 25.0, "humidity_pct": 50.0, "wind_speed_ms": 2.0, "cloud_cover_pct": 0.0},
    "features": {},
    "physics": {
        "cloud_factor": 1.0, "wind_cooling_factor": 0.0, "irradiance_wm2": 0.0, "module_temp_c": 25.0, "soiling_ratio": 1.0,
        "temp_loss_pct": 0.0, "effective_efficiency": 1.0,
    },
    "predict": {"efficiency_loss_pct": 0.0, "estimated_output_w": 0.0, "prediction_successful": False},
    "recommend": {"overall_severity": "OK", "summary": "No issues detected.", "recommendation": NO_ACTION},
}


def run(df: DataFrame, as_of: Column | None = None, raw_prediction: Column | None = None, s: Settings = DEFAULT, predictor: str | None = None) -> DataFrame:
    """Observations with inputs to finished runs; one projection over its input, so batch and streaming alike.

    ``df``: observation columns, run inputs, and ``image_error``, ``detection_error``,
    ``classification_error`` (text or null), ``weather_crashed``. ``as_of`` stands in for missing times. Where there are columns
    ``detection_error_type``, ``classification_error_type`` or ``prediction_error_type``, they tell a model that can't be
    loaded from one that fails; ``model_error`` is what the model behind ``raw_prediction`` says of a row. ``predictor`` is the
    place of a saved regressor; with neither, the surrogate from the physics columns stands in.
    """
    if as_of is not None:
        df = df.withColumn("observation_time", observed_at(F.col("observation_time"), as_of))
    df = df.withColumn("city", default_if_empty(F.col("city"), s.default_city)).withColumn("_inputs", input_error())
    df = settled(with_features(with_physics(df, s), s), "features")
    df = settled(validated(df, RAW_COLUMNS), "validated")
    if predictor is not None:
        df = with_saved_model(df, predictor, s.model_columns)
        raw_prediction = F.col("raw_prediction")
    typed = {stage: f"{name}_error_type" for stage, name in (("detect", "detection"), ("classify", "classification"), ("predict", "prediction")) if f"{name}_error_type" in df.columns}
    model_error = F.col("model_error") if "model_error" in df.columns else None
    df = with_prediction(df, surrogate_loss(F.col("effective_efficiency")) if raw_prediction is None else raw_prediction, s, model_error)
    df = settled(with_report(settled(df, "predictions"), s), "reports")
    errors = {
        "image": F.col("image_error"),
        "inputs": F.col("_inputs"),
        "detect": F.col("detection_error"),
        "classify": F.col("classification_error"),
        "weather": F.when(F.col("weather_crashed"), GENERIC),
        "features": feature_error(),
        "predict": F.col("prediction_error"),
    }
    stage, message, kind = F, F, F
    for i, (name, error) in enumerate(errors.items()):
        usual, subject = KINDS[name]
        text, own = error_text(usual, error, subject), F.lit(usual)
        if name in typed:
            unloaded = F.col(typed[name]) == "ModelLoadError"
            text = F.when(unloaded, error_text("ModelLoadError", error, subject)).otherwise(text)
            own = F.coalesce(F.col(typed[name]), own)
        stage = stage.when(error.isNotNull(), F.lit(i))
        message = message.when(error.isNotNull(), text)
        kind = kind.when(error.isNotNull(), own)
    df = df.withColumns(
        {"_stage": stage.otherwise(F.lit(len(STAGES) - 1)), "error_message": message.otherwise(F.lit("")), "error_type": kind.otherwise(F.lit(""))}
    )
    # "physics" comes after weather and can't fail: its columns stay once weather is done
    reached = {"detect": 2, "classify": 3, "weather": 4, "physics": 4, "features": 5, "predict": 6, "recommend": 6}
    resets = {
        column: F.when(F.col("_stage") > reached[name], F.col(column)).otherwise(F.lit(value))
        for name, columns in UNREACHED.items()
        for column, value in columns.items()
    }
    names = F.array(*[F.lit(x) for x in STAGES])
    return settled(
        df.withColumns(resets)
        .withColumn("status", F.when(F.col("_stage") == len(STAGES) - 1, "SUCCESS").otherwise("ERROR"))
        .withColumn("error_stage", F.get(names, F.col("_stage")))
        .drop("_stage", "_inputs"),
        "runs",
    )
