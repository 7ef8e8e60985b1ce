"""Operators for preparing training text. Nothing else in histframe imports this package.

Each module holds one operator; ``queries`` binds them to the synthetic tables.
"""
