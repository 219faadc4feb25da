"""A bitemporal evidence engine on PySpark."""
