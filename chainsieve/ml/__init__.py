"""Model fitting, prediction and calibration on Spark ML."""
