"""A statistical analytics engine on Spark DataFrames."""
