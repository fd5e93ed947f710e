"""sievework: inspect files as rows of a DataFrame, and evaluate the inspectors, on Spark."""
