"""Company and contact-address analytics as Spark DataFrame operators."""
