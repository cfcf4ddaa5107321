"""News knowledge graphs, factors and streams on Spark."""
