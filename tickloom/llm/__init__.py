"""Training-data operators over documents, pages and benchmark tables.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; intermediate tables that cut lineage go to the shared folder named
by ``spark.checkpoint.dir`` (see ``common.shared_dir``).
"""
