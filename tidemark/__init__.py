"""Tidemark: KPI time-series anomaly detection and stream reconciliation as Spark plans."""
