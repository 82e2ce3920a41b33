"""operators of the early-warning library."""
