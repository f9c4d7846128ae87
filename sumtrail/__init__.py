"""Business-table analytics as Spark DataFrame operators."""
