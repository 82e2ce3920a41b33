"""Entity-by-week early-warning analytics expressed as Spark DataFrame transformations."""
