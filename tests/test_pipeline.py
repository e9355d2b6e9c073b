from __future__ import annotations

from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.parquet as pq

from strandlens.plans import pipeline
from strandlens.spec import AnalysisConfig, StrandConfig

T0 = datetime(2025, 4, 1)


def write_strand(folder, level):
    folder.mkdir()
    n = 400
    half = [T0 + timedelta(seconds=i // 2) for i in range(2 * n)]
    whole = [T0 + timedelta(seconds=i) for i in range(n)]
    pq.write_table(pa.table({"plainTimeStamp": half, "meniscus_bff_c01": [float(i % 5) for i in range(2 * n)]}), folder / "boExpert.parquet")
    pq.write_table(
        pa.table(
            {
                "plainTimeStamp": whole,
                "castingSpeed": [0.02] * n,
                "moldWidth": [1.5] * n,
                "SENImmersionDepth": [0.15] * n,
                "Mold Level": [level(i) / 1000 for i in range(n)],
                "EMBR Current AC Left Master": [100.0 if i != 250 else 0.0 for i in range(n)],
                "EMBR Current DC Left Master": [50.0] * n,
                "EMBR Current DC Left Bottom": [70.0] * n,
            }
        ),
        folder / "dtExpert.parquet",
    )


def test_two_strands_end_to_end(spark, tmp_path):
    write_strand(tmp_path / "s5", lambda i: 100.0 + (i % 3) * 0.1)
    write_strand(tmp_path / "s6", lambda i: 100.0 + (20.0 if 20 <= i < 60 else 0.0))
    strands = [
        StrandConfig(5, "Strand 23-5", str(tmp_path / "s5"), str(tmp_path / "out")),
        StrandConfig(6, "Strand 23-6", str(tmp_path / "s6"), str(tmp_path / "out")),
        StrandConfig(7, "Strand 23-7", str(tmp_path / "absent"), str(tmp_path / "out")),
        StrandConfig(8, "Strand 23-8", str(tmp_path / "s8"), str(tmp_path / "out")),
    ]
    # A file that looks sound by its end, with pages that can't be read.
    write_strand(tmp_path / "s8", lambda i: 100.0)
    data = bytearray((tmp_path / "s8" / "dtExpert.parquet").read_bytes())
    data[4 : len(data) // 2] = b"\xff" * (len(data) // 2 - 4)
    (tmp_path / "s8" / "dtExpert.parquet").write_bytes(bytes(data))
    castings = spark.createDataFrame(
        [(5, T0, T0 + timedelta(seconds=100), "1A"), (6, T0, T0 + timedelta(hours=1), "3B")],
        "`Strand ID` int, ts_start timestamp, ts_end timestamp, `Quality casting` string",
    )
    cfg = AnalysisConfig(window_size=100)
    pipeline.run(spark, strands[:1], castings, cfg=cfg, export=True)
    out = pipeline.run(spark, strands, castings, cfg=cfg, export=True)
    rows = out["sequences"].orderBy("strand", "Seq_Name").collect()
    # Row 250 is inactive; one second is missing there, which is no gap.
    assert [(r.strand, r.Seq_Name) for r in rows] == [
        (s.name, f"seq_{i:04d}") for s in strands[:2] for i in range(3)
    ]
    assert [r["Quality casting"] for r in rows] == ["1A", "1A", None, "3B", "3B", "3B"]
    assert [r.disturbance_type for r in rows] == ["Normal"] * 3 + [
        "Excursion + High variability", "Normal", "Normal"
    ]
    assert all(abs(r["CASTING_SPEED_avg [m/min]"] - 1.2) < 1e-9 for r in rows)
    assert all(r.Seq_num_samples == 100 for r in rows)
    # 399 active rows: after three windows 99 are left, too few for another.
    assert out["abnormal"].count() == 0
    for n in (5, 6):
        folder = tmp_path / "out" / f"strand_{n}"
        assert spark.read.option("header", True).csv(str(folder / f"sequence_statistics_strand{n}_latest.csv")).count() == 3
    assert sorted(out["failed"]) == ["Strand 23-7", "Strand 23-8"]
    totals = {(r.strand, r.sequences, r.stable_sequences) for r in out["summary"].collect()}
    assert totals == {("Strand 23-5", 3, 3), ("Strand 23-6", 3, 2)}
    report = tmp_path / "out" / "strand_6" / "summary_report_latest.txt"
    lines = [r.value for r in spark.read.text(str(report)).collect()]
    assert lines[0] == "Analysis Summary, Strand 23-6" and "Stability / Stable: 2.000 (66.7%)" in lines
