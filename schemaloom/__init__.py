"""Schema catalog analytics on Spark: registration logs and schema documents in, catalog tables out."""
