"""Schemas of the documents the measuring tools and checks write."""

EVENT = (
    "type string, start_time double, end_time double, timestamp double, severity string, "
    "details string, confidence double, source_module string"
)


def struct_of(fields: str) -> str:
    """``a int, b string`` as ``struct<a:int,b:string>``."""
    # Nested types are written without blanks after their commas.
    parts = [p.strip().split(" ", 1) for p in fields.split(", ")]
    return "struct<" + ",".join(f"{n}:{t}" for n, t in parts) + ">"


EVENT_ARRAY = f"array<{struct_of(EVENT)}>"

# ``details`` is free-form and kept as JSON text; events are read from it.
REPORT = (
    "module string, video_file string, status string, effective_status string, segment_offset_sec double, "
    f"metrics map<string,string>, events {EVENT_ARRAY}, details string"
)

STREAM = (
    "codec_type string, width string, height string, duration string, sample_aspect_ratio string, "
    "display_aspect_ratio string, channels string, bit_rate string, tags map<string,string>"
)
PROBE = (
    "format struct<format_name:string,duration:string,bit_rate:string>, "
    f"streams array<{struct_of(STREAM)}>"
)
FRAME_STATS = "frames array<struct<pkt_pts_time:string,tags:map<string,string>>>"

SEGMENT_LIST = "name string, start_time double, end_time double"
