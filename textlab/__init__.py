"""Text feature engineering and classical-model scoring on Spark DataFrames."""
