"""A bitemporal dimension engine on Spark: nothing that was believed is ever overwritten."""
