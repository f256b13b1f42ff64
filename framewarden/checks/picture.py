"""Checks of container structure and picture geometry, one row per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timecode import parse_ratio
from .base import PASSED, REJECTED, WARNING, event, is_strict, list_events


def _streams(kind: str) -> Column:
    return F.filter("streams", lambda s: s["codec_type"] == kind)


def _number(text: Column, kind: str = "double") -> Column:
    return F.coalesce(text.try_cast(kind), F.lit(0).cast(kind))


def structure_metrics(probes: DataFrame) -> DataFrame:
    """Container, duration, bit rate and number of tracks of each kind."""
    return probes.withColumns(
        {
            "container": F.col("format.format_name"),
            "duration_sec": _number(F.col("format.duration")),
            "bitrate_bps": _number(F.col("format.bit_rate"), "long"),
            "track_count_video": F.size(_streams("video")),
            "track_count_audio": F.size(_streams("audio")),
            "track_count_subs": F.size(_streams("subtitle")),
        }
    )


def duration_mismatch() -> Column:
    """Container and first video stream differ by more than half a second."""
    whole = _number(F.col("format.duration"))
    stream = _number(F.get(_streams("video"), 0)["duration"])
    return (whole > 0) & (stream > 0) & (F.abs(whole - stream) > 0.5)


def missing_language(kind: str, mode: Column | str) -> Column:
    tracks = _streams(kind)
    language = F.coalesce(F.try_element_at(F.get(tracks, 0)["tags"], F.lit("language")), F.lit("und"))
    return is_strict(mode) & (F.size(tracks) > 0) & (language == "und")


def structure_events(probes: DataFrame, mode: Column | str) -> DataFrame:
    """Needs ``header_ok`` and ``intact`` next to ``format`` and ``streams``."""
    ok = F.col("header_ok")
    whole, stream = F.col("format.duration"), F.get(_streams("video"), 0)["duration"]
    return list_events(
        probes,
        F.when(~ok, event("corrupt_header", F.lit("Could not parse container header."))),
        F.when(
            ok & duration_mismatch(),
            event(
                "metadata_mismatch",
                F.concat(F.lit("Container duration ("), whole, F.lit("s) mismatches stream ("), stream, F.lit("s).")),
            ),
        ),
        F.when(ok & missing_language("video", mode), event("missing_metadata", F.lit("Video track missing language tag."))),
        F.when(ok & missing_language("audio", mode), event("missing_metadata", F.lit("Audio track missing language tag."))),
        F.when(ok & ~F.col("intact"), event("integrity_failure", F.lit("Integrity Check Failed"))),
    )


def structure_status(probes: DataFrame) -> DataFrame:
    """An unreadable header ends the check early: rejected, yet effectively passed."""
    ok, intact = F.col("header_ok"), F.col("intact")
    return probes.withColumns(
        {
            "status": F.when(ok & intact, PASSED).otherwise(REJECTED),
            "effective_status": F.when(~ok, PASSED)
            .when(~intact, REJECTED)
            .when(duration_mismatch(), WARNING)
            .otherwise(PASSED),
        }
    )


def calculated_aspect(df: DataFrame) -> DataFrame:
    """Adds ``display_ratio`` (from metadata) and ``calculated_ratio``."""
    sar, dar = parse_ratio(F.col("sar")), parse_ratio(F.col("dar"))
    shape = F.when(F.col("height") > 0, F.col("width") / F.col("height")).otherwise(F.lit(0.0))
    return df.withColumns(
        {"display_ratio": dar, "calculated_ratio": F.when(sar > 0, shape * sar).otherwise(shape)}
    )


def aspect_ratio_check(df: DataFrame, tolerance: float = 0.05) -> DataFrame:
    shown, real = F.col("display_ratio"), F.col("calculated_ratio")
    bad = (shown > 0) & (F.abs(shown - real) > tolerance)
    return calculated_aspect(df).withColumn("status", F.when(bad, WARNING).otherwise(PASSED))


def blanking(df: DataFrame) -> DataFrame:
    """Adds ``active_share`` and ``blanking_pct`` of the detected picture area."""
    share = F.when(F.col("width") * F.col("height") > 0,
                   F.col("act_w") * F.col("act_h") / (F.col("width") * F.col("height")))
    return df.withColumn("active_share", share).withColumn("blanking_pct", 100.0 * (1.0 - F.col("active_share")))


def active_area_check(df: DataFrame, mode: Column | str, tolerance_pct: float = 1.0, prior: Column | None = None) -> DataFrame:
    """Verdict after the active-area test; ``prior`` is the verdict before it."""
    small = (F.col("blanking_pct") > tolerance_pct) & (F.col("active_share") < 0.75)
    before = F.lit(PASSED) if prior is None else prior
    return blanking(df).withColumn("status", F.when(is_strict(mode) & small, REJECTED).otherwise(before))


def active_area_findings(tolerance_pct: float = 1.0) -> dict[str, Column]:
    """What the blanking of a file amounts to; needs :func:`blanking`'s columns."""
    over = F.col("blanking_pct") > tolerance_pct
    yes = lambda c: F.coalesce(over & c, F.lit(False))
    return {
        "letterbox": yes(F.col("act_h") < F.col("height") * 0.99),
        "pillarbox": yes(F.col("act_w") < F.col("width") * 0.99),
        "small_area": yes(F.col("active_share") < 0.75),
    }


def active_area_events(df: DataFrame, tolerance_pct: float = 1.0) -> DataFrame:
    found = active_area_findings(tolerance_pct)
    return list_events(
        blanking(df),
        F.when(found["letterbox"], event("letterbox_detected", F.format_string(
            "Content is letterboxed. Active height %d < %d (Blanking: %.1f%%)", "act_h", "height", "blanking_pct"))),
        F.when(found["pillarbox"], event("pillarbox_detected", F.format_string(
            "Content is pillarboxed. Active width %d < %d (Blanking: %.1f%%)", "act_w", "width", "blanking_pct"))),
        F.when(found["small_area"], event("small_active_area", F.format_string(
            "Active video uses only %d%% of canvas. 'Postage stamp' artifact.",
            (F.col("active_share") * 100).cast("long")))),
    )
