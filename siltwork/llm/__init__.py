"""Training-data operators: packing, filtering, near-duplicates, extraction, archives and scans.

Nothing outside this subpackage imports it.  ``queries.py`` holds the thin driver queries and
``oracle.py`` their SQL, so that ``__spark_entry__`` can add both when the folder is present.
"""
