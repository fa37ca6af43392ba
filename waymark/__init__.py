"""Analytics over recorded tracks, expressed as DataFrames."""
