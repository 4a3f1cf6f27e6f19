"""Operators for preparing large text and vector collections.

Nothing outside this folder imports it; ``__spark_entry__.py`` adds its queries
when the folder is there.
"""
