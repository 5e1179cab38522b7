"""A PySpark engine for building, scoring and analysing visual-question-answering quality datasets."""
