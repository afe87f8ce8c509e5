"""Tessera: an analytics engine written against the Spark DataFrame and SQL APIs."""
