"""Training-data operators: one module per operator, `queries` registers the ten op queries."""
