"""Training-data operators: ten large-corpus steps and the queries that apply them. Nothing else in the library imports this."""
