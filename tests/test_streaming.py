from lattica.operators import dbscan
from lattica.streaming import assign


def test_new_points_join_the_cluster_of_the_nearest_core_point(spark, tmp_path):
    x = [[0.0, 0.0], [0.1, 0.0], [0.2, 0.0], [5.0, 5.0], [5.1, 5.0], [5.2, 5.0]]
    points = spark.createDataFrame(list(enumerate(x)), "id bigint, v array<double>")
    core = points.join(dbscan.dbscan(points, 0.25, 3).where("is_core"), "id").select("v", "label")
    spark.createDataFrame([(10, [0.05, 0.1]), (11, [5.3, 5.0]), (12, [2.0, 2.0])], points.schema).write.parquet(f"file://{tmp_path}/in")
    got = {}

    def keep(batch, _):
        batch = batch.persist()
        near = assign.assign(batch, core, 0.25, 2)
        got.update({r.id: r.label for r in assign.nearest(near, batch).collect()})
        batch.unpersist()

    stream = spark.readStream.schema(points.schema).parquet(f"file://{tmp_path}/in")
    run = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert got == {10: 0, 11: 1, 12: -1}
