"""Operators on very large corpora and metric tables; nothing outside this subpackage imports it."""
