"""Compliance profiles as a small dimension table."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FALLBACK = "strict"

# The profile settings.  Their sorted JSON gives the version hash,
# so names, order of magnitude and number types all count.
PROFILES = {
    "strict": {
        "description": "Generic Broadcaster (EBU R128 / R37)",
        "audio": {
            "integrated_loudness_target": -23.0,
            "loudness_tolerance": 1.0,
            "true_peak_max": -1.0,
            "max_silence_sec": 2.0,
            "min_phase_correlation": 0.0,
        },
        "video": {
            "black_frame_threshold": 0.1,
            "freeze_frame_max_sec": 0.5,
            "dropped_frame_max": 0,
            "require_progressive": True,
        },
        "sync": {"tolerance_ms": 22.0},
        "ml_artifacts": {
            "enabled": True,
            "model": "BRISQUE",
            "sample_rate_fps": 1.0,
            "threshold_score": 55.0,
            "severity_thresholds": {"mild": 35.0, "moderate": 55.0, "severe": 75.0},
            "min_duration_sec": 1.0,
        },
    },
    "netflix_hd": {
        "description": "Netflix Delivery Spec v9.1 (HD/UHD)",
        "audio": {
            "integrated_loudness_target": -24.0,
            "loudness_tolerance": 2.0,
            "true_peak_max": -2.0,
            "max_silence_sec": 0.5,
            "min_phase_correlation": 0.05,
        },
        "video": {
            "black_frame_threshold": 0.05,
            "freeze_frame_max_sec": 0.0,
            "dropped_frame_max": 0,
            "require_progressive": True,
        },
        "sync": {"tolerance_ms": 40.0},
        "ml_artifacts": {
            "enabled": True,
            "model": "BRISQUE",
            "sample_rate_fps": 1.0,
            "threshold_score": 50.0,
            "severity_thresholds": {"mild": 30.0, "moderate": 50.0, "severe": 70.0},
            "min_duration_sec": 1.0,
        },
    },
    "youtube": {
        "description": "YouTube / Web Upload (Loose)",
        "audio": {
            "integrated_loudness_target": -14.0,
            "loudness_tolerance": 3.0,
            "true_peak_max": 0.0,
            "max_silence_sec": 5.0,
            "min_phase_correlation": -0.1,
        },
        "video": {
            "black_frame_threshold": 0.2,
            "freeze_frame_max_sec": 2.0,
            "dropped_frame_max": 15,
            "require_progressive": False,
        },
        "sync": {"tolerance_ms": 100.0},
        "ml_artifacts": {
            "enabled": True,
            "model": "BRISQUE",
            "sample_rate_fps": 0.5,
            "threshold_score": 65.0,
            "severity_thresholds": {"mild": 45.0, "moderate": 65.0, "severe": 85.0},
            "min_duration_sec": 2.0,
        },
    },
    "ott": {
        "description": "General OTT (Amazon/Hulu)",
        "audio": {"integrated_loudness_target": -24.0},
        "ml_artifacts": {"enabled": True, "model": "BRISQUE", "threshold_score": 55.0},
    },
}

# What a check assumes when the profile leaves a key out.
DEFAULTS = {
    "integrated_loudness_target": -23.0,
    "loudness_tolerance": 1.0,
    "true_peak_max": -1.0,
    "min_phase_correlation": 0.0,
    "ml_enabled": False,
    "sample_rate_fps": 1.0,
    "mild": 40.0,
    "moderate": 55.0,
    "severe": 70.0,
    "min_duration_sec": 1.0,
}

COLUMNS = (
    ("profile", "string"),
    ("description", "string"),
    ("config_hash", "string"),
    ("integrated_loudness_target", "double"),
    ("loudness_tolerance", "double"),
    ("true_peak_max", "double"),
    ("max_silence_sec", "double"),
    ("min_phase_correlation", "double"),
    ("black_frame_threshold", "double"),
    ("freeze_frame_max_sec", "double"),
    ("dropped_frame_max", "int"),
    ("require_progressive", "boolean"),
    ("tolerance_ms", "double"),
    ("ml_enabled", "boolean"),
    ("sample_rate_fps", "double"),
    ("threshold_score", "double"),
    ("mild", "double"),
    ("moderate", "double"),
    ("severe", "double"),
    ("min_duration_sec", "double"),
)


def config_hash(name: str) -> str:
    """First eight hex digits of SHA-256 over the key-sorted JSON settings."""
    settings = PROFILES.get(name, PROFILES[FALLBACK])
    return hashlib.sha256(json.dumps(settings, sort_keys=True).encode()).hexdigest()[:8]


def _flat(name: str) -> dict:
    p = PROFILES[name]
    ml = p.get("ml_artifacts", {})
    return {
        "profile": name,
        "description": p.get("description"),
        "config_hash": config_hash(name),
        **p.get("audio", {}),
        **p.get("video", {}),
        **p.get("sync", {}),
        **{k: v for k, v in ml.items() if k not in ("enabled", "severity_thresholds", "model")},
        "ml_enabled": ml.get("enabled"),
        **ml.get("severity_thresholds", {}),
    }


def _literal(value, kind: str) -> str:
    if value is None:
        return f"cast(null as {kind})"
    if kind == "string":
        return "'" + value + "'"
    if kind == "double":
        return f"{value!r}e0"
    return str(value).lower()


def profile_values() -> str:
    """The table as SQL rows, shared by Spark and the check SQL."""
    rows = []
    for name in PROFILES:
        flat = _flat(name)
        rows.append("(" + ", ".join(_literal(flat.get(c), k) for c, k in COLUMNS) + ")")
    return "values " + ", ".join(rows)


def profiles_table(spark: SparkSession) -> DataFrame:
    return spark.sql(f"select * from ({profile_values()}) as p({', '.join(c for c, _ in COLUMNS)})")


def _kind_of(values: list) -> T.DataType:
    """The type of all given values; a dictionary is a struct of all its keys."""
    if isinstance(values[0], dict):
        names = list(dict.fromkeys(k for v in values for k in v))
        return T.StructType([T.StructField(k, _kind_of([v[k] for v in values if k in v])) for k in names])
    return {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType()}[type(values[0])]


def settings_rows(spark: SparkSession) -> DataFrame:
    """``profile, settings``: the nested settings of each profile, for ``functions.canonical.settings_hash``."""
    kind = T.StructType([T.StructField("profile", T.StringType()), T.StructField("settings", _kind_of(list(PROFILES.values())))])
    return spark.createDataFrame(list(PROFILES.items()), kind)


def setting(name: str) -> Column:
    """A profile column, or the check's own default where the profile has none."""
    return F.coalesce(F.col(name), F.lit(DEFAULTS[name]))


def join_profile(df: DataFrame, profiles: DataFrame, on: str = "profile") -> DataFrame:
    """Add the settings of each row's profile, ``resolved_profile`` its name.

    The given table decides which names are known; others use its ``strict`` row.
    """
    known = profiles.select(F.col("profile").alias("_known")).distinct()
    resolved = df.join(known, F.col(on) == F.col("_known"), "left").withColumn(
        "resolved_profile", F.coalesce("_known", F.lit(FALLBACK))
    ).drop("_known")
    dim = profiles.withColumnRenamed("profile", "resolved_profile")
    return resolved.join(dim, "resolved_profile", "left")


def with_profile(df: DataFrame, profiles: DataFrame, name: str) -> DataFrame:
    """The settings of one profile as literal columns; an unknown name uses ``strict``.

    Its row is picked before the plan is built, so no join is planned.
    """
    rows = {r["profile"]: r for r in profiles.where(F.col("profile").isin(name, FALLBACK)).collect()}
    row = rows.get(name, rows.get(FALLBACK))
    fields = [f for f in profiles.schema.fields if f.name != "profile"]
    return df.withColumns({
        "resolved_profile": F.lit(row["profile"] if row else FALLBACK),
        **{f.name: F.lit(row[f.name] if row else None).cast(f.dataType) for f in fields},
    })


def governance(df: DataFrame, profiles: DataFrame, on: str = "profile", name: str | None = None) -> DataFrame:
    """``active_profile, config_version_hash, compliance_standard`` for every row.

    ``name`` stands for a profile that is the same for all rows.
    """
    few = profiles.select("profile", "config_hash", "description")
    joined = join_profile(df, few, on) if name is None else with_profile(df.withColumn(on, F.lit(name)), few, name)
    return joined.select(
        *df.columns,
        F.col(on).alias("active_profile"),
        F.col("config_hash").alias("config_version_hash"),
        F.coalesce("description", F.lit("Custom")).alias("compliance_standard"),
    )
