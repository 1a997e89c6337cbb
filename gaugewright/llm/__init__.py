"""Training-data operators: ten operators, the queries that apply them, and their shared helpers.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds its queries when it is present.
"""
