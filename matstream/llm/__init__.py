"""Training-data operators over text, page and embedding tables.

One module per operator, a module of queries and one of SQL oracles.  Nothing
outside this subpackage imports it.
"""
