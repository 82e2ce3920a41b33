"""sources of the early-warning library."""
