"""Dunlin: payment-recovery analytics as Spark DataFrame operators.

Every operator takes DataFrames (or Columns) and returns a DataFrame (or Column).  Time is always
an argument, money is always ``bigint`` paise, and nothing reads a clock or a random source.
"""
