"""parchmill: document analytics on PySpark DataFrames."""
