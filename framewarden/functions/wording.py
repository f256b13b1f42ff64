"""How events are named, grouped, scored and exported."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severity scores (any other word scores 1).
SEVERITY_SCORES = {
    "CRITICAL": 5,
    "REJECTED": 5,
    "SEVERE": 5,
    "MODERATE": 3,
    "WARNING": 2,
    "MILD": 1,
    "PASSED": 0,
    "UNKNOWN": 1,
}

# Display colour of each category.
CATEGORY_COLOURS = {
    "Audio": "#1f77b4",
    "Audio Quality": "#1f77b4",
    "Video Error": "#d62728",
    "Video Quality": "#ff7f0e",
    "Archival": "#00bcd4",
    "Sync": "#2ca02c",
    "Structure": "#9467bd",
    "Metadata": "#8c564b",
    "Other": "#7f7f7f",
}

# Category, export code and the words that select it, first hit
# wins.  Words are looked for in the module (m), the type (t) or the details (d).
CATEGORY_RULES = (
    ("Audio", "AUD", (("m", "audio"), ("m", "loudness"), ("t", "silence"))),
    ("Sync", "SYN", (("m", "sync"), ("t", "drift"))),
    ("Structure", "STR", (("m", "structure"), ("t", "metadata"))),
    ("Archival", "ARC", (("t", "broadcast"), ("t", "saturation"))),
    ("Video Quality", "VQUAL", (("t", "artifact"), ("t", "bitrate"), ("d", "block"))),
    ("Video Error", "VERR", (("t", "black"), ("t", "freeze"), ("t", "interlace"))),
)


def event_start(start: Column, timestamp: Column) -> Column:
    return F.coalesce(start, timestamp, F.lit(0.0))


def event_end(end: Column, start: Column) -> Column:
    """A missing end is one second after the (normalised) start."""
    return F.coalesce(end, start + 1.0)


def _chain(pick: int, other: str, type_: Column, module: Column, details: Column) -> Column:
    text = {k: F.lower(F.coalesce(c, F.lit(""))) for k, c in (("m", module), ("t", type_), ("d", details))}
    out = None
    for rule in CATEGORY_RULES:
        hit = F.lit(False)
        for where, word in rule[2]:
            hit = hit | F.contains(text[where], F.lit(word))
        out = F.when(hit, rule[pick]) if out is None else out.when(hit, rule[pick])
    return out.otherwise(other)


def event_category(type_: Column, module: Column, details: Column) -> Column:
    return _chain(0, "Other", type_, module, details)


def event_code(type_: Column, module: Column, details: Column) -> Column:
    return _chain(1, "GEN", type_, module, details)


def _lookup(mapping: dict, key: Column, default) -> Column:
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(F.try_element_at(table, key), F.lit(default))


def severity_word(severity: Column) -> Column:
    return F.upper(F.coalesce(severity, F.lit("UNKNOWN")))


def severity_score(severity: Column) -> Column:
    return _lookup(SEVERITY_SCORES, severity_word(severity), 1)


def category_colour(category: Column) -> Column:
    return _lookup(CATEGORY_COLOURS, category, CATEGORY_COLOURS["Other"])


def human_name(type_: Column) -> Column:
    """Underscores to spaces, title case.

    ``initcap`` only starts words after blanks; a letter after a digit or sign
    is a start too, so such texts go letter by letter.
    """
    text = F.replace(F.lower(F.coalesce(type_, F.lit("unknown"))), F.lit("_"), F.lit(" "))
    letters = F.split(text, "")
    titled = F.array_join(
        F.transform(
            letters,
            lambda c, i: F.when((i > 0) & F.get(letters, i - 1).rlike("[a-z]"), c).otherwise(F.upper(c)),
        ),
        "",
    )
    return F.when(text.rlike("[^a-z ][a-z]"), titled).otherwise(F.initcap(text))


def display_duration(start: Column, end: Column) -> Column:
    """Length to draw: instantaneous events get half a second."""
    length = end - start
    return F.when(length <= 0, F.lit(0.5)).otherwise(length)
