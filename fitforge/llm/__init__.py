"""Training-data operators: filtering, deduplication, packing, tokens, privacy.

Every operator is a function from DataFrames to a DataFrame.  ``queries`` holds
the registered queries; nothing outside this subpackage imports it.
"""
