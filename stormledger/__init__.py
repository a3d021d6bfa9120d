"""Anticipatory risk analytics over Spark tables.

Every public operator takes and returns DataFrames (or Columns), reads thresholds and weights from
tables or parameters, and treats event, step and forecast horizon as columns.
"""
