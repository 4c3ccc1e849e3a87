"""Training-data operators: text quality, language, privacy, packing and deduplication.

Nothing outside this subpackage imports it; ``queries`` registers its queries.
"""
