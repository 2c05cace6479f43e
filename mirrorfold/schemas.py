"""Columns of the tables that operators exchange."""

from pyspark.sql import types as T

FILES = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("folder", T.StringType(), False),
        T.StructField("size", T.LongType(), False),
        T.StructField("last_modified", T.TimestampType()),
    ]
)
#: num_files and total_size count direct files only.
FOLDERS = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("parent_path", T.StringType()),
        T.StructField("num_files", T.LongType(), False),
        T.StructField("total_size", T.LongType(), False),
    ]
)
SCAN_ERRORS = T.StructType([T.StructField("path", T.StringType(), False), T.StructField("message", T.StringType(), False)])
HASH_CACHE = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("size", T.LongType(), False),
        T.StructField("last_modified", T.TimestampType()),
        T.StructField("algorithm", T.StringType(), False),
        T.StructField("kind", T.StringType(), False),
        T.StructField("hash", T.StringType()),
    ]
)
#: What the walker reports: folders, files and errors in one table.
WALK = T.StructType(
    [
        T.StructField("kind", T.StringType(), False),
        T.StructField("path", T.StringType(), False),
        T.StructField("name", T.StringType()),
        T.StructField("parent", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("last_modified", T.TimestampType()),
        T.StructField("inode", T.StringType()),
        T.StructField("message", T.StringType()),
    ]
)
