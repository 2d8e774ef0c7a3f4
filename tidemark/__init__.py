"""Tidemark: keep a sharded target table in step with a commit-ordered change feed.

Every operator takes and returns Spark DataFrames (or Columns) and stays lazy,
except where a docstring says that it freezes a split or writes a table.
"""
