"""Lattica: property-graph rule analytics expressed as Spark DataFrame plans."""
