"""shelfwise: recommendation analytics as Spark DataFrame jobs.

Catalogue + interaction log in, tables of profiles, popularity, similar items,
diverse alternatives, hybrid top-k recommendations and offline metrics out.
"""

__version__ = "0.1.0"
