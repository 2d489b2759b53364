"""DataFrame operators: each takes DataFrames and returns DataFrames, without actions unless it says so."""
