"""Image-retrieval and geo-localization analytics on Spark DataFrames."""
