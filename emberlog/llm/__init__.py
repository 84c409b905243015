"""Operators for preparing language-model training data.

Every operator takes a DataFrame of documents and names the columns it reads, so extra
columns of the input never clash with its own. Queries over the given tables are in
``queries``; nothing outside this package imports it except the contract file.
"""
