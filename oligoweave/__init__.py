"""Set-at-a-time DNA primer-panel analytics on Spark DataFrames."""
