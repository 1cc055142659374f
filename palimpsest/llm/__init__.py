"""Training-data operators: the ten numbered operators and what they share.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries when it is there.
"""
