"""marquetry: a PySpark-native engine for reviewing collections of source code and text.

Every operator is a function from DataFrames to a DataFrame; nothing is collected inside the library.
"""
