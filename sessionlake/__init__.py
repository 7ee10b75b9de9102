"""A PySpark-native engine for conversation transcripts."""
