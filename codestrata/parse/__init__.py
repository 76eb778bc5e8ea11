"""Functions and their flat control-flow nodes from source text, without grammars.

Python is read by its own parser; other languages by a tokenizer, which sets strings and comments
aside, and a scanner of statements driven by a table of rules for each language.
"""
