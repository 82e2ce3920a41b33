"""functions of the early-warning library."""
