"""Instance matching between two knowledge graphs, as Spark DataFrame operators."""
