"""quire: a Spark-native engine for document evidence.

Documents become pages, pages become line blocks, blocks become chunks whose
spans lead back to the page, and chunks become searchable and measurable
tables. Every operator is a function from DataFrames to a DataFrame.
"""
