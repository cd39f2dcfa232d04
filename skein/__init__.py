"""skein: neighbour graphs and manifold embedding as Spark jobs."""
