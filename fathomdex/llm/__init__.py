"""Training-data operators: mixing, filtering, classifying, deduplicating and sharding.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds its
queries only when it is present.
"""
