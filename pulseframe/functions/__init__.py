"""Column functions: units, calibration, names."""
