"""Fixed schemas as DDL; readers never infer."""

POINTS = "timestamp_ns long NOT NULL, parameter_id long NOT NULL, value double NOT NULL"
VERSIONED = "timestamp_ns long, parameter_id long, value double, ordinal long, run_id long"
ROWS = "timestamp_ns long, columns array<struct<parameter_id: long, value: double>>"
FRAMES = "seq string, ts_monotonic double, values map<string, struct<parameter_id: string, value: string>>"
# Keys and columns of the file formats.
LAYOUT_HEADER = ["major_frame_sec", "minor_frames", "description", "layout"]
LAYOUT_ENTRY = ["name", "description", "parameter_id", "unit", "word", "minor_frames", "hz", "type"]
VERSIONED_COLUMNS = ["timestamp_ns", "parameter_id", "value", "ordinal", "run_id"]
POINT_COLUMNS = ["timestamp_ns", "parameter_id", "value"]
AGGREGATE_COLUMNS = ["start_ts_ns", "end_ts_ns", "parameter_id", "count", "min", "max", "avg"]
MAX_PARAMETER_ID = (1 << 32) - 1
