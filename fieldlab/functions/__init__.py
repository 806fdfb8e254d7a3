"""Scalar formulas as Column factories: everything stays in Catalyst expressions.

Arguments are column names, Columns or numbers.  Guards mirror the formulas' domains:
where a formula is undefined the result is the documented default or an error raised by the
plan, never a silent division by zero.
"""
