"""Operators for text corpora: cleaning, near-duplicate search, scoring, packing.

Every module holds one operator with a general interface; ``queries`` registers one query
for each over the given tables. Rules that hold for all of them:

* Columns are picked by name and renamed on entry, so other columns, whatever they are
  called, are never touched. A null text counts as an empty text unless a module says otherwise.
* Rows that repeat are kept: as many rows come out as went in, with equal results.
* An empty table gives an empty result with the full schema.
* Intermediate tables are written to the folder in ``spark.checkpoint.dir``.
"""
