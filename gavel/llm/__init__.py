"""Training-data operators: ten corpus operators, their queries and their SQL.

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries
when the folder is there.
"""
