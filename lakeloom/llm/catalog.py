"""Imports every module of the subpackage so that its queries are registered."""

from . import (  # noqa: F401
    chat_format, language_id, lattice_dedup, lexical_search, license_scan, line_dedup, mixing, ngram_join, packing,
    prefix_trie, suffix_dedup, token_counts, vptree_search,
)
from .registry import ORACLE, QUERIES  # noqa: F401
