"""Timeline analytics and text-corpus preparation as Spark DataFrame operators."""
