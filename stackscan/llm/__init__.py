"""Operators for preparing training text: filtering, de-duplication, tokenising, packing, sharding."""
