"""Training-data operators: language ID, decontamination, scoring, dedup, tokens, shards, archives.

Nothing outside this subpackage imports it; the rest of the library works without it.
"""
