import hashlib
from datetime import timezone

from dateutil import parser
from pyspark.sql import functions as F

from topicflow.functions import ids


def test_external_and_article_ids(spark):
    rows = [("x", "t", "s", "d", "b"), ("", "t", None, "", "b"), (None, None, None, None, "b")]
    df = spark.createDataFrame(rows, "g string, t string, s string, d string, b string")
    got = df.select(
        ids.external_id(*[F.col(c) for c in "gtsdb"]).alias("e"),
        ids.article_id(F.col("g"), F.col("t"), F.col("d"), F.col("b")).alias("a"),
    ).collect()

    def sha(s):
        return hashlib.sha256(s.encode()).hexdigest()

    assert [r["e"] for r in got] == ["x", sha("t|||b"), sha("|||b")]
    assert [r["a"] for r in got] == ["x", sha("tb"), sha("b")]


def test_iso_dates(spark):
    good = [
        "2024", "2024-03", "2024-03-04", "20240304", "2024-W09", "2024-W09-3", "2024W093", "2020-W53-7",
        "2024-03-04T05", "2024-03-04T05:06", "2024-03-04 05:06:07", "20240304T050607", "2024-03-04T05:06:07.12",
        "2024-03-04T05:06:07,123456789", "2024-03-04T05:06:07Z", "2024-03-04T05:06:07+03:00",
        "2024-03-04T05:06:07-0330", "2024-03-04T05:06+03", "2024-03-04T24:00",
    ]
    bad = ["", " ", "not a date", "2024-13-01", "2024-02-30", "2024-1-2", "04.03.2024", "2024-03-04T25:00", "2024-03-04T05:61", None]
    df = spark.createDataFrame([(v,) for v in good + bad], "v string")
    got = {r["v"]: r["t"] for r in df.select("v", F.unix_micros(ids.parse_iso8601(F.col("v"))).alias("t")).collect()}
    for v in good:
        want = parser.isoparse(v)
        want = want if want.tzinfo else want.replace(tzinfo=timezone.utc)
        assert got[v] == round(want.timestamp() * 1e6), v
    assert all(got[v] is None for v in bad), [v for v in bad if got[v] is not None]


def test_error_is_cut(spark):
    assert spark.range(1).select(F.length(ids.truncate_error(F.repeat(F.lit("я"), 1500)))).first()[0] == 1000
