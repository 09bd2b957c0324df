"""latticework: sparse linear algebra and data preparation on Spark DataFrames."""
