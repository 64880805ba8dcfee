"""lexloom: document, citation and record analytics expressed as Spark plans.

Subpackages
-----------
functions   column expressions (text, html, citations, urls, dates, names)
operators   DataFrame -> DataFrame operators built from those expressions
sources     readers for tables, files, journals
plans       named end-to-end plans with their oracle SQL
streaming   Structured Streaming forms of the journal operators
"""

__version__ = "0.1.0"
