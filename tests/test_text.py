"""Column functions on columns of any name."""

import hashlib

from pyspark.sql import functions as F

from spanloom.functions import text as X


def test_uri_path_and_content_key_read_their_arguments(spark):
    rows = spark.createDataFrame([("file:///a%20b+c", "0123456789"), ("/plain", "abc"), (None, None)], "place string, body string")
    got = rows.select(X.uri_path(F.col("place")).alias("path"), X.content_key(F.length("body"), F.col("body"), 3).alias("key")).collect()
    assert [x.path for x in got] == ["/a b+c", "/plain", None]
    assert [x.key for x in got[:2]] == [hashlib.sha1(x).hexdigest() for x in (b"10012789", b"3abc")]
