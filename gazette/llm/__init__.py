"""Operators that prepare training text: each module holds one operator and its query."""
