"""Fleetwear: sensor-degradation analytics as Spark DataFrame plans."""
