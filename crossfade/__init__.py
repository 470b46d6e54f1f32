"""Longitudinal transition analytics as plain Spark DataFrame code.

Event rows become one metric row per (entity, season, group); the metric is
standardised within its cohort, moves between units are detected, and a panel
in time relative to the first qualifying move feeds profiling, cleaning,
feature, regression and mixed-model operators.
"""
