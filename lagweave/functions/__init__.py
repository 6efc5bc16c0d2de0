"""Column functions: distribution tails and fit metrics."""
