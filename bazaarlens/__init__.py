"""Price-panel econometrics as Spark jobs: DataFrame-to-DataFrame operators keyed by series, pair, period or replicate."""
