"""Training-data operators: scoring, deduplication, decontamination, mixing.

Every module holds one operator with its own general interface; ``queries``
registers the thin ``opN_<name>`` queries and their SQL. Nothing else in the
library imports this subpackage.
"""
