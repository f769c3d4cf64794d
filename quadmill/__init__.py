"""quadmill: vector tiling and training-data operators on Spark."""
