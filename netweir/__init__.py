"""netweir: network-flow analytics on PySpark DataFrames."""
