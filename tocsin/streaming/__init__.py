"""streaming of the early-warning library."""
