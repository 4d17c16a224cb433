"""Maintenance advice: four rules, each at most one finding a row, ordered by severity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions.numeric import at_least, fixed
from panelwright.settings import DEFAULT, Settings

RANKS = {"CRITICAL": 3, "WARNING": 2, "INFO": 1, "OK": 0}
# Findings of each label, and the summaries.
LABEL_FINDINGS = {
    "Clean": ("OK", "Panel surface is clean. No cleaning required.", "Continue regular inspection schedule"),
    "Dusty": ("WARNING", "Dust accumulation detected. Cleaning will restore output.", "Schedule surface cleaning"),
    "Bird-Drop": (
        "WARNING", "Bird-drop contamination detected. Localised soiling reduces output.", "Clean affected cells promptly",
    ),
    "Electrical-Damage": (
        "CRITICAL", "Electrical damage detected. Risk of arc fault or fire. Do not operate.",
        "Disconnect panel and contact a certified electrician immediately",
    ),
    "Physical-Damage": (
        "CRITICAL", "Physical damage (cracking or delamination) detected. Structural integrity compromised.",
        "Replace the damaged panel",
    ),
    "Hotspot": (
        "CRITICAL", "Hotspot detected. Localised overheating can cause permanent damage and is a fire risk.",
        "Inspect bypass diodes and shading sources; replace if needed",
    ),
}
UNKNOWN_ACTION = "Perform visual inspection"
SUMMARIES = {
    "CRITICAL": "⚠️ Critical issues detected — immediate action required.",
    "WARNING": "⚡ Maintenance recommended within 7 days.",
    "INFO": "ℹ️ Minor advisory — re-inspect during next scheduled visit.",
    "OK": "✅ Panel is operating within normal parameters.",
}
NO_ACTION = "No action required"
COLOURS = {"CRITICAL": "error", "WARNING": "warning", "INFO": "info", "OK": "success"}


def _finding(order: int, severity: str, message: Column | str, action: str) -> Column:
    """Sorts by falling rank, then by rule: ``place`` makes the order stable."""
    text = message if isinstance(message, Column) else F.lit(message)
    return F.struct(
        F.lit(-RANKS[severity]).alias("place"), F.lit(order).alias("rule"), F.lit(severity).alias("severity"),
        text.alias("message"), F.lit(action).alias("action"),
    )


def fault_class(label: Column) -> Column:
    """Always one finding; an unknown label asks for inspection."""
    text = F.concat(F.lit("Fault class '"), F.coalesce(label, F.lit("None")), F.lit("' detected. Manual inspection recommended."))
    found = F
    for name, (severity, message, action) in LABEL_FINDINGS.items():
        found = found.when(label == name, _finding(0, severity, message, action))
    return found.otherwise(_finding(0, "INFO", text, UNKNOWN_ACTION))


def efficiency_loss(loss: Column, s: Settings = DEFAULT) -> Column:
    start = F.concat(F.lit("Predicted efficiency loss of "), fixed(loss, 1))
    critical = F.concat(start, F.lit(f"% exceeds the critical threshold ({s.loss_critical_pct:.0f}%). Immediate intervention required."))
    advisory = F.concat(start, F.lit(f"% is above the advisory threshold ({s.loss_warning_pct:.0f}%). Plan maintenance soon."))
    return F.when(
        at_least(loss, s.loss_critical_pct), _finding(1, "CRITICAL", critical, "Schedule emergency maintenance")
    ).when(at_least(loss, s.loss_warning_pct), _finding(1, "WARNING", advisory, "Schedule maintenance within 7 days"))


def module_temperature(module_c: Column, s: Settings = DEFAULT) -> Column:
    text = F.concat(
        F.lit("Module temperature ("), fixed(module_c, 1), F.lit(f"°C) exceeds safe operating limit ({s.hot_module_c:.0f}°C).")
    )
    return F.when(
        at_least(module_c, s.hot_module_c),
        _finding(2, "WARNING", text, "Check for shading, soiling, or ventilation obstructions"),
    )


def low_irradiance(irradiance: Column, s: Settings = DEFAULT) -> Column:
    text = F.concat(
        F.lit("Irradiance is very low ("), fixed(irradiance, 0),
        F.lit(" W/m²). Predictions are less reliable under night/heavy overcast conditions."),
    )
    return F.when(irradiance < s.low_irradiance_wm2, _finding(3, "INFO", text, "Re-run analysis during daylight hours"))


def findings(s: Settings = DEFAULT) -> Column:
    """Array of findings from ``label``, ``efficiency_loss_pct``, ``module_temp_c``, ``irradiance_wm2``; most severe first."""
    every = F.array(
        fault_class(F.col("label")), efficiency_loss(F.col("efficiency_loss_pct"), s),
        module_temperature(F.col("module_temp_c"), s), low_irradiance(F.col("irradiance_wm2"), s),
    )
    return F.array_sort(F.filter(every, lambda x: x.isNotNull()))


def severity_of(found: Column) -> Column:
    """The highest severity of an ordered array; OK of an empty one."""
    return F.coalesce(F.get(found, F.lit(0))["severity"], F.lit("OK"))


def with_report(df: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Adds ``recommendations``, ``overall_severity``, ``summary``, ``recommendation`` (top action) and ``priority``."""
    summaries = F.create_map(*[F.lit(x) for kv in SUMMARIES.items() for x in kv])
    return (
        df.withColumn("_found", findings(s))
        .withColumn("overall_severity", severity_of(F.col("_found")))
        .withColumn("recommendation", F.coalesce(F.get("_found", F.lit(0))["action"], F.lit(NO_ACTION)))
        .withColumn("recommendations", F.transform("_found", lambda x: F.struct(x["severity"], x["message"], x["action"])))
        .withColumn("summary", F.element_at(summaries, F.col("overall_severity")))
        .withColumn("priority", F.col("overall_severity"))
        .drop("_found")
    )


def long_form(df: DataFrame, s: Settings = DEFAULT, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """One row per finding with its ``position`` from 0."""
    return df.select(*keys, F.posexplode(findings(s)).alias("position", "f")).select(
        *keys, "position", "f.severity", "f.message", "f.action"
    )


def report_json() -> Column:
    """The report as JSON: status, summary, issues, recommendation, priority."""
    return F.to_json(
        F.struct(
            F.col("overall_severity").alias("status"), "summary", F.col("recommendations").alias("issues"), "recommendation", "priority"
        )
    )


def colour(severity: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in COLOURS.items() for x in kv]), severity), F.lit("info"))
