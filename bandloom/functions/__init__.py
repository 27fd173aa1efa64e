"""Scalar functions as SQL text: each takes SQL expressions and returns one, for ``F.expr``, ``selectExpr`` or ``spark.sql``.

All are built of functions that stay inside Spark's generated code, and that other SQL engines share, so that the same
text serves as an oracle. Null arguments give null unless a docstring says otherwise.
"""
