"""Training-data operators: de-duplication, scans, scoring, tokenizing and
packing of a corpus, plus nearest neighbours.

Every operator is a function from DataFrames to a DataFrame. ``queries``
registers one thin query per operator over the given tables.
"""
