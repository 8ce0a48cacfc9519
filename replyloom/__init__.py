"""Support-conversation analytics as Spark DataFrame operators."""
