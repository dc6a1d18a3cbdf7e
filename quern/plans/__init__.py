"""From query text to DataFrames."""
