"""plans of the early-warning library."""
