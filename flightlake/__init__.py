"""A PySpark-native engine for high-rate, multi-parameter telemetry.

Points are ``(timestamp_ns BIGINT, parameter_id BIGINT, value DOUBLE)``; of several points
with one key the newest run wins, and inside a run the last one written. Every operator
takes and returns DataFrames and leaves the physical plan to Catalyst.
"""
