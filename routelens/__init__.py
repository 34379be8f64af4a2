"""Location-integrity and model-health analytics as Spark DataFrame operators."""
