"""histframe: versioned-data analytics on Spark DataFrames.

Histories (objects, trees, commits, refs, ref logs, index and working-copy
snapshots) are ordinary tables; every operator is a plan over them.
"""

__version__ = "0.1.0"
