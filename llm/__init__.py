"""Training-data operators: deduplication, mixing, counting, filtering, packing and search.

Nothing outside this package imports it; ``registry`` lists its queries.
"""
