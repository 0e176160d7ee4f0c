"""Training-data pipeline operators (language ID, near-duplicates, packing, ...).

Self-contained: nothing else in the library imports this subpackage.
``catalog`` registers one query ``opN_<name>`` per operator.
"""
