from lodestar.streaming.answers import write_parsed_answers


def test_answers_from_a_stream(spark, tmp_path):
    schema = "query_id LONG, content STRING, model STRING, usage INT"
    rows = [(1, "See http://a.b/c.  Yes", "m", 3), (2, "", None, None)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = write_parsed_answers(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination(120)
    got = {r.query_id: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[1].content == "See http://a.b/c. Yes" and got[1].urls == ["http://a.b/c"]
    assert got[2].content == "No content returned from API." and got[2].model == "unknown"
