"""Evidence-graded knowledge graphs as Spark DataFrames."""
