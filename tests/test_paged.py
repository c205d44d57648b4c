"""Paged collections: pages followed by their tokens, in batch and as a stream."""

import json
import os

from melisma.sources import paged


def land(path, collection, token, rows, following):
    folder = f"{path}/collection={collection}/token={token}"
    os.makedirs(folder)
    with open(f"{folder}/page.json", "w") as f:
        f.write(rows if isinstance(rows, str) else json.dumps({"rows": rows, "next": following}))


def test_batch_and_stream(spark, tmp_path):
    path = str(tmp_path / "in")
    land(path, "a", "first", ["x", {"k": 1}], "p2")
    land(path, "a", "p2", ["y"], None)
    land(path, "b", "first", ["u"], "lost")
    land(path, "c", "first", "{not json", None)
    land(path, "d", "first", [], "e")
    land(path, "d", "e", ["v"], "first")  # goes round: ends at most_pages
    spark.dataSource.register(paged.Paged)
    rows = lambda df: sorted(map(tuple, df.collect()))
    a, b, d = [("a", 0, 0, "x"), ("a", 0, 1, '{"k": 1}'), ("a", 1, 0, "y")], [("b", 0, 0, "u")], [("d", 1, 0, "v"), ("d", 3, 0, "v")]
    assert rows(spark.read.format("paged").option("most_pages", 5).load(path)) == a + b + d
    assert rows(spark.read.format("paged").load(str(tmp_path / "nothing"))) == []

    def run():
        stream = spark.readStream.format("paged").option("most_pages", 5).load(path)
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(once=True).start().awaitTermination()
        return rows(spark.read.parquet(str(tmp_path / "out")))

    assert run() == a + b + d
    land(path, "b", "lost", ["w"], None)  # the page has come after all
    land(path, "z", "first", ["new"], None)
    assert run() == sorted(a + b + d + [("b", 1, 0, "w"), ("z", 0, 0, "new")])
