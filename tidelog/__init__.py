"""Log, event and text-corpus analytics as PySpark DataFrame operators."""
