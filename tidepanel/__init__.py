"""Panel time-series preparation, evaluation and forecasting on Spark DataFrames."""
