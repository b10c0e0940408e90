"""Training-data operators: archives, filters, deduplication, tokens, safety.

Nothing else in the library imports this subpackage.  ``registry`` lists its
queries and their SQL for the entry module.
"""
