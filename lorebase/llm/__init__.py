"""Training-data operators: deduplication, decontamination, quality, language, tokens, secrets, mixing.

Nothing outside this package imports it.  Every operator is a function from DataFrames to a DataFrame.
"""
