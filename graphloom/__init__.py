"""Structure analytics on Spark: typed dependency graphs and the records attached to them."""
