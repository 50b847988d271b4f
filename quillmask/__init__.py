"""quillmask: a PySpark-native engine for finding, reviewing and removing personal data in text collections."""
