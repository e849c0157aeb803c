"""Analytics over particle frames and trajectories as Spark DataFrames."""
