"""Corpus operators: tokens, deduplication, similarity joins, extraction, archives, packing and filters.

Every operator takes and returns DataFrames. Rules that hold for all of them:

* Only the named id and text columns are read; other columns never clash with internal ones.
* A null text counts as the empty text; a null id stays null in the result.
* Repeated rows stay repeated; an empty table gives an empty result of the same schema.
"""
