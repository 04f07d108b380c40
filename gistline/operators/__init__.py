"""Jobs over tables: every function takes and returns DataFrames."""
