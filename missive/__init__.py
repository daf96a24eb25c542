"""Analytics for large collections of short, labelled text messages, on PySpark."""
