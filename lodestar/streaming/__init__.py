"""The row-wise steps over streaming DataFrames."""
