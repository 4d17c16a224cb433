"""Fleet diagnostics for photovoltaic panels, and corpus preparation, on Spark DataFrames."""
