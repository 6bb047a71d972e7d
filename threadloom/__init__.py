"""threadloom: grounded mail-thread retrieval analytics as Spark DataFrame operators."""
