from pyspark.sql import functions as F

from bytegram.plans import registry as R
from bytegram.plans import requests as RQ

SF = "/root/testdata/sf0.001"


def test_request_errors(spark):
    reqs = spark.createDataFrame(
        [(1, "documents", "count", "the", None, None), (2, "nope", "count", "the", None, None),
         (3, "documents", "grep", "the", None, None), (4, "documents", "count", None, None, None),
         (5, "documents", "get_doc_by_rank", "x", 7, 0), (6, "documents", "get_doc_by_rank", "x", 0, -1)],
        "req_id long, index string, query_type string, query string, s int, rank long") \
        .withColumn("max_results", F.lit(None).cast("int")).withColumn("max_ctx_len", F.lit(None).cast("int"))
    err = {r["req_id"]: r["error"] for r in RQ.validate(reqs, ["documents"], {"documents": 4}).collect()}
    assert err[1] is None
    assert err[2].startswith("Unknown index")
    assert err[3].startswith("Unknown query_type")
    assert err[4].startswith("Missing required field")
    assert "out of range" in err[5]
    assert err[6].startswith("rank must be non-negative")


def test_dispatch_counts_match_count_batch(spark):
    out = R.QUERIES["dispatch_batch"](spark, SF)
    counts = {r["req_id"]: r["count"] for r in out.filter("query_type = 'count' AND error IS NULL").collect()}
    direct = {r["qid"] * 100: r["count"] for r in R.QUERIES["count_batch"](spark, SF).collect()}
    assert counts == direct
    searches = out.filter("query_type = 'search'").groupBy("req_id").count().collect()
    assert all(r["count"] <= 3 for r in searches)
