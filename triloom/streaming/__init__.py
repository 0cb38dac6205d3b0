"""Batch queries only: the query language has no streaming operators, so there are none here.

Results are DataFrames, so a caller can write them from foreachBatch of a Structured Streaming query.
"""
