"""Frame-series analytics expressed as Spark DataFrame transformations."""
