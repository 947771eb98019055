"""Set-level operators: every one takes DataFrames and returns DataFrames."""
