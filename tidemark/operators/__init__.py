"""Operators on KPI frames."""
