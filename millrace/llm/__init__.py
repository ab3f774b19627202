"""Operators for cleaning and tokenising training text.

Nothing outside this folder imports it, apart from the guarded registration in
``__spark_entry__.py`` and the pipeline script.
"""
