"""Operators for preparing training text: filters, de-duplication, packing, counting and scoring."""
