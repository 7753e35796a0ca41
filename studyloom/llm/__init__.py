"""Training-data operators: text corpora in, decisions, spans, counts and files out.

Nothing outside this subpackage imports it.
"""
