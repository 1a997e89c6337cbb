"""A PySpark engine that decides whether acquired data support a declared sensor-calibration claim."""
