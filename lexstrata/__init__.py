"""Analytics over versioned, hierarchical legal text, as Spark DataFrames."""
