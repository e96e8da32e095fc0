"""Spark-first document analytics: extraction, ranking, visits, review state, calibration and reports as DataFrame plans."""
