"""carteel: map-registration analytics on Spark DataFrames."""
