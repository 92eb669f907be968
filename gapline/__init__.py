"""Transcript segmentation, calibration and corpus operators for Spark DataFrames."""
