"""Training-data operators: one module per operator, plus the queries over the test tables."""
