"""Training-data operators: the ten corpus components and their queries."""
