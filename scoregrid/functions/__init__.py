"""Column expressions: Column to Column, no DataFrames and no Python workers."""
