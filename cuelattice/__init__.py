"""cuelattice: a Spark-first analytics engine for word-representation studies."""
