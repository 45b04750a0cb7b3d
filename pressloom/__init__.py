"""pressloom: coverage analytics as DataFrame plans on Apache Spark."""
