"""Order risk models: splits, fits, calibration, metrics and scores."""
