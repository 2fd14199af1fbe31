"""riskframe: lending-risk features, binning, selection, metrics and scoring on Spark."""
