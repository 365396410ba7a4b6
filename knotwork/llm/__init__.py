"""Training-data operators: filters, de-duplication, search, mixing, sharding.

Nothing else in the library imports this subpackage.
"""
