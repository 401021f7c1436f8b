"""Operators for preparing training data for language models.

Nothing else in the library imports this subpackage, and it imports nothing
from the rest of the library, so it can be removed as a whole.
"""
