"""lexloom: a PySpark-native engine for analysing corpora of legal text."""
