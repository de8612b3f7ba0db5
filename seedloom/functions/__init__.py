"""Column functions: draws, seeds and generators."""
