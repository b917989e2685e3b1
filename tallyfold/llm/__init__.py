"""Operators of a training-data pipeline over a table of documents (doc_id, text, lang, source, n_chars).

Nothing outside this subpackage imports it. Every operator selects the columns it needs first, so extra columns
with any name never clash, and reads a null text as the empty text.
"""
