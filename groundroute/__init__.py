"""Ground path planning from overhead imagery, as Spark jobs."""
