"""Training-data pipeline operators over the ``documents`` table.

Nothing else in the package imports this subpackage.  Every operator reads only
the columns it names (``doc_id`` and ``text`` by default), so extra columns with
any name never clash with the columns it makes.
"""
