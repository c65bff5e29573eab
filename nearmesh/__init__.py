"""nearmesh: nearest-neighbour graphs over dense vectors, as DataFrame operations."""
