"""Streams over a table of the warehouse, stored as one file or as a folder of files."""
from docledger.plans import streams as S


def _seen(spark, rows, out):
    rows.writeStream.foreachBatch(lambda df, n: df.write.parquet(f"{out}/batch={n}")).option("checkpointLocation", f"{out}-ck").trigger(availableNow=True).start().awaitTermination()
    return sorted(r.event_id for r in spark.read.parquet(str(out)).select("event_id").collect())


def test_folder_of_files_and_single_file(spark, rows, tmp_path):
    folder, single = tmp_path / "folder", tmp_path / "single"
    events = rows("event_id LONG", [(i,) for i in range(20)])
    events.repartition(3).write.parquet(f"{folder}/events.parquet")
    rows("event_id LONG", [(99,)]).write.parquet(f"{folder}/other_events.parquet")
    events.coalesce(1).write.parquet(str(tmp_path / "written"))
    single.mkdir()
    (single / "events.parquet").write_bytes(next((tmp_path / "written").glob("part-*.parquet")).read_bytes())
    for sf in (folder, single):
        assert _seen(spark, S._stream(spark, str(sf), "events"), tmp_path / f"out-{sf.name}") == list(range(20))
