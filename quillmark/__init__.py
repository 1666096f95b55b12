"""quillmark: a PySpark-native engine for text forensics and authorship analysis."""
