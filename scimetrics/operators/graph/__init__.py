"""Graph operators: every cell of a grid is one graph and all are computed together."""
