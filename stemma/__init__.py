"""stemma: a Spark-native engine for ordered technical text, its dependency graph and retrieval."""
