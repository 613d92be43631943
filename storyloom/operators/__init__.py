"""DataFrame transforms of the engine."""
