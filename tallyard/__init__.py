"""tallyard: a PySpark-native engine for auditing, splitting, running and scoring question-answering evaluations."""
