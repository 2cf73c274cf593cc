"""Set-based recommendation operators over DataFrames."""
