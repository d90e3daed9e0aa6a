"""Training-data operators and their registered queries."""
