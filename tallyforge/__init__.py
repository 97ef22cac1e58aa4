"""Audit, profiling and modelling of aggregated count tables on Spark."""
