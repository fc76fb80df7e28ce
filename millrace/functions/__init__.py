"""Column builders: vector functions, losses, metrics."""
