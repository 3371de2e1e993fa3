"""Order-aware relational processing on PySpark DataFrames."""
