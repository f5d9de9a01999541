"""Label-quality analytics on Spark: declarative DataFrame operators, one function each."""
