import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from kinetable.sources import keypoint_tables as KT
from kinetable.sources.skeletons import mhr70, skeleton_for, tier_cohorts
from kinetable.streaming.windows import with_blocks


def test_long_csv(spark, tmp_path):
    f = tmp_path / "k.csv"
    f.write_text("video,frame,joint_no,x,y,fps\na,0,0,1,2,25\na,1.0,0,NaN,3,25\na,1,0,4,none,30\na,-1,0,1,1,25\na,z,0,1,1,25\n")
    raw = KT.read_raw_csv(spark, str(f))
    got = KT.parse_keypoints(raw, {"part_idx": "joint_no"}).orderBy("frame").collect()
    assert [(r["frame"], r["x"], r["y"]) for r in got] == [(0, 1.0, 2.0), (1, 4.0, None)]
    assert KT.video_fps(raw, {"part_idx": "joint_no"}).first()["fps"] == 25.0
    with pytest.raises(ValueError, match="missing columns"):
        KT.parse_keypoints(raw)


def test_walk_archives(spark, tmp_path):
    folder = tmp_path / "COH"
    folder.mkdir()
    np.savez(folder / "h36m_3d_world_a.npz", s1__w1=np.ones((4, 17, 3)), flat=np.zeros((3, 51)))
    np.savez(folder / "h36m_3d_world2cam_a.npz", decoy=np.ones((9, 17, 3)))
    got = KT.read_walk_archives(spark, str(tmp_path)).groupBy("cohort", "subject", "walk_id").agg(F.count("*").alias("n")).collect()
    assert {(r["cohort"], r["subject"], r["walk_id"], r["n"]) for r in got} == {("COH", "s1", "w1", 68), ("COH", "flat", "flat", 51)}


def test_run_history_and_sinks(spark, tmp_path):
    run = tmp_path / "runs" / "r1"
    run.mkdir(parents=True)
    (run / "history.json").write_text('{"train": [{"loss": 1, "rec_full": 2}], "val": [{"loss": 3, "rec_full": 4}, {"loss": 2.5, "rec_full": 5}]}')
    r = KT.summarize_runs(KT.read_run_history(spark, str(tmp_path / "runs"))).first()
    assert (r["run"], r["val_loss_min_epoch"], r["val_rec_min"], r["train_rec_final"]) == ("r1", 1, 4.0, 2.0)
    for fmt in ("parquet", "csv", "json"):
        KT.write_table(spark.range(5), str(tmp_path / fmt), fmt)
        assert spark.read.format(fmt).load(str(tmp_path / fmt)).count() >= 5


def test_skeletons():
    assert len(mhr70().names) == 70 and len(set(mhr70().names)) == 70 and len(mhr70().bones) == 65
    assert skeleton_for(15).pairs and skeleton_for(18).n_joints == 18
    with pytest.raises(ValueError):
        skeleton_for(17)
    assert tier_cohorts(1)[0] == "BMCLab"


def test_blocks_on_a_stream(spark, tmp_path):
    spark.range(100).select(F.col("id").alias("start_frame")).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("start_frame long").parquet(str(tmp_path / "in"))
    q = with_blocks(s, 10.0, 2.0).writeStream.format("memory").queryName("blocks").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("blocks").where("block <> floor(start_frame / 20)").count() == 0


def test_entry_and_contract(spark):
    df = entry.entry(spark)
    assert df.columns == ["metric", "video", "value"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
