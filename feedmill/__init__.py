"""Feed analytics on PySpark: collecting, cleaning, checking and querying news-style feed entries."""
