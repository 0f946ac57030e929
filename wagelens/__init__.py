"""wagelens: pay-survey analytics expressed as Spark DataFrame plans.

Sub-packages:
  sources    -- reading the survey CSVs / driver tables, writing tables
  functions  -- Column-expression helpers (parsing, money, levels)
  operators  -- filters, sort/page, grouped statistics, search, quality
  streaming  -- change capture, apply, Structured Streaming sync
  plans      -- the named query catalog used by __spark_entry__.py
"""

__all__ = ["session"]
