"""resurvey: field-survey analytics as Spark DataFrame operators."""
