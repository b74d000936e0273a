"""Column functions with Python's semantics.

Most are compositions of built-in expressions and stay in the JVM; the few whose
exact text or rules no built-in gives are Arrow-batched and say so.
"""
