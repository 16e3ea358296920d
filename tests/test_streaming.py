"""The same graders on a stream of generations."""

from pyspark.sql import functions as F

from gradeloom.functions import extract as E
from gradeloom.functions import grade as G
from gradeloom.streaming.grading import grade_stream


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    said = F.concat(F.lit("it is "), F.col("value").cast("string"))
    generations = events.select(F.col("event_id").alias("sample_id"), said.alias("generation"))
    generations.repartition(3).write.parquet(str(tmp_path / "in"))
    samples = events.select(F.col("event_id").alias("sample_id"), F.round("value").alias("answer"))

    stream = spark.readStream.schema(generations.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    graded = grade_stream(stream, samples, E.last_number, G.same_answer)
    writer = (
        graded.writeStream.format("parquet")
        .option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True)
    )
    query = writer.start()
    assert query.awaitTermination(120)
    columns = ["sample_id", "prediction", "correct"]
    batch = grade_stream(generations, samples, E.last_number, G.same_answer)
    streamed = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(streamed.select(columns).collect()) == sorted(batch.select(columns).collect())
    assert 0 < streamed.where("correct").count() < streamed.count()
