"""quarry: a Spark-native search-and-rank engine over hierarchical record catalogs."""
