"""Training-data operators: ten large-corpus operators and their queries."""
