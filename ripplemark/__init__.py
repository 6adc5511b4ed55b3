"""ripplemark: risk-propagation analytics on Spark DataFrames."""
