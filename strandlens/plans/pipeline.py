"""From two raw logs and the casting metadata to labelled windows.

Every step is a DataFrame operator with the strand as a key, so all strands run
in one plan and nothing is brought to the driver. Results that several steps
read are staged as files in the shared scratch folder.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import active_filter, convert_units, process_filter, project_present
from ..functions.timing import _column
from ..operators.detectors import flag_disturbances
from ..operators.intervals import attach
from ..operators.ordered import fit_chunks, with_tiebreak
from ..operators.reports import strand_summary, summary_report
from ..operators.reshape import union_strands
from ..operators.stats import downsample, sequence_stats
from ..operators.windows import (
    abnormal_starts,
    number_windows,
    pick_windows,
    segmented_starts,
    sequence_name,
    window_rows,
)
from ..sources.readers import read_logs
from ..sources.sinks import scratch_path, stage, write_csv, write_parquet, write_report
from ..spec import AnalysisConfig, SignalSpec, StrandConfig

_ROUNDED = "_rounded_speed"


def join_logs(temperatures: DataFrame, process: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of both logs that share their keys. A further column that both logs carry is an error: which log's value
    were meant can't be told."""
    both = [c for c in process.columns if c in temperatures.columns and c not in keys]
    if both:
        raise ValueError(f"both logs carry {', '.join(both)}")
    return temperatures.join(process, list(keys))


def load_strand(spark: SparkSession, strand: StrandConfig) -> DataFrame:
    """The joined logs of one strand, in physical units."""
    temperatures, process = read_logs(spark, strand.logs)
    if temperatures is None or process is None:
        raise FileNotFoundError(f"{strand.name}: both logs are needed in {strand.logs}")
    ts = "plainTimeStamp"
    return convert_units(join_logs(downsample(temperatures, [ts]), process, [ts]))


def load_strands(
    spark: SparkSession, strands: Sequence[StrandConfig]
) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """The strands that can be read, and why the others cannot."""
    frames, failed = {}, {}
    for strand in strands:
        try:
            frames[strand.name] = load_strand(spark, strand)
        except (FileNotFoundError, ValueError, AnalysisException) as error:
            failed[strand.name] = str(error)
    return frames, failed


def clean_signal(
    frames: Mapping[str, DataFrame],
    strands: Sequence[StrandConfig],
    castings: DataFrame,
    spec: SignalSpec,
    cfg: AnalysisConfig,
) -> DataFrame:
    """Cleaned rows of all strands with the grade of their casting.

    The process filter and the null check run before the casting join, which
    they do not depend on. ``castings`` carries ``Strand ID``, ``ts_start``,
    ``ts_end`` and the grade.
    """
    joined = union_strands(frames)
    numbers = F.create_map(*[F.lit(x) for s in strands for x in (s.name, s.number)])
    joined = joined.withColumn("Strand ID", F.element_at(numbers, F.col("strand")))
    clean = process_filter(
        joined, spec.speed, spec.depth, cfg.min_casting_speed, cfg.depth_min, cfg.depth_max
    ).na.drop(subset=[spec.ts, spec.speed, spec.width, spec.depth])
    labelled = attach(
        clean, castings, spec.ts, "ts_start", "ts_end", [spec.quality], keys=["Strand ID"]
    )
    level_sensors = ["Mold Level Sensor Left", "Mold Level Sensor Right"]
    wanted = [
        *spec.keys, *spec.order, spec.speed, spec.width, spec.depth, spec.level,
        *level_sensors, *spec.gas, spec.quality, *spec.currents,
    ]
    return project_present(labelled, wanted)


def stable_sequences(
    signal: DataFrame, spec: SignalSpec, cfg: AnalysisConfig, rounded: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Active rows with window marks, and the chosen windows with their number.

    The window search sees the rounded speed, the statistics the raw one. Both
    results are staged, because several later steps read them.
    """
    starts = segmented_starts(
        active_filter(signal, spec.currents), spec.keys, spec.order, spec.chunk(), spec.speed,
        cfg.window_size, cfg.speed_threshold, spec.currents, cfg.current_threshold,
        cfg.max_gap_seconds, rounded=_ROUNDED if rounded else None,
    )
    starts = stage(starts, "starts")
    picks = pick_windows(starts, spec.keys, cfg.window_size)
    return starts, stage(number_windows(picks, spec.keys), "picks")


def classify_windows(
    starts: DataFrame, picks: DataFrame, spec: SignalSpec, cfg: AnalysisConfig
) -> DataFrame:
    """Statistics, flags and label of every chosen window."""
    rows = window_rows(starts, picks, spec.keys, cfg.window_size)
    keys = [*spec.keys, "segment_id", "start_pos", "seq_no"]
    stats = sequence_stats(rows, keys, spec, keep_samples="_samples")
    flagged = flag_disturbances(stats, "_samples", cfg).drop("_samples")
    return flagged.withColumn("Seq_Name", sequence_name("seq_no")).drop("seq_no")


def analyze(signal: DataFrame, spec: SignalSpec, cfg: AnalysisConfig) -> dict[str, DataFrame]:
    """Labelled windows and rejected starts of a cleaned signal."""
    starts, picks = stable_sequences(signal, spec, cfg)
    return {
        "sequences": classify_windows(starts, picks, spec, cfg),
        "abnormal": abnormal_starts(starts, picks, spec.keys, cfg.window_size),
    }


def stage_strands(
    frames: Mapping[str, DataFrame],
    strands: Sequence[StrandConfig],
    castings: DataFrame,
    spec: SignalSpec,
    cfg: AnalysisConfig,
) -> tuple[DataFrame, dict[str, str]]:
    """The cleaned signal of all strands, staged strand by strand, and why some could not be: a strand whose files turn out
    to be broken costs none of the others."""
    whole = clean_signal(frames, strands, castings, spec, cfg)
    spark, failed = whole.sparkSession, {}
    path = scratch_path(spark, "signal")
    for name in frames:
        own = clean_signal({name: frames[name]}, strands, castings, spec, cfg)
        missing = {f.name: F.lit(None).cast(f.dataType) for f in whole.schema.fields if f.name not in own.columns}
        own = own.withColumns(missing).select(*[_column(f.name).cast(f.dataType).alias(f.name) for f in whole.schema.fields])
        try:
            write_parquet(own, path, spec.keys, "append")
        except Exception as error:  # whatever a file's reader raises in a task
            failed[name] = str(error).split("\n")[0]
    if len(failed) == len(frames):
        raise FileNotFoundError(f"no strand can be read: {failed}")
    return spark.read.schema(whole.schema).parquet(path), failed


def run(
    spark: SparkSession,
    strands: Sequence[StrandConfig],
    castings: DataFrame,
    spec: SignalSpec | None = None,
    cfg: AnalysisConfig | None = None,
    export: bool = False,
    stamp: str = "latest",
) -> dict[str, object]:
    """The whole analysis of all strands that can be read.

    Returns the frames ``signal``, ``sequences``, ``abnormal`` and ``summary``,
    and under ``failed`` the strands left out with the reason. The cleaned
    signal is used several times, so it is staged once, by strand, in the shared
    scratch folder, and the chunks of ordered scans are fitted to it. With ``export`` each strand's windows and report are
    written to its own folder, over those of an earlier run of the same stamp.
    """
    spec, cfg = spec or SignalSpec(), cfg or AnalysisConfig()
    frames, failed = load_strands(spark, strands)
    if not frames:
        raise FileNotFoundError(f"no strand can be read: {failed}")
    signal, broken = stage_strands(frames, strands, castings, spec, cfg)
    ordered, spec = with_tiebreak(signal, spec)
    spec = fit_chunks(ordered, spec)
    out = {"signal": signal, "failed": failed | broken, **analyze(ordered, spec, cfg)}
    if export:
        out["sequences"] = stage(out["sequences"], "sequences")
        for strand in strands:
            if strand.name not in out["failed"]:
                export_strand(out["sequences"], strand, stamp, spec, cfg)
    sigma, label = "MOLD_LEVEL_std [mm]", "disturbance_type"
    out["summary"] = strand_summary(out["sequences"], spec.keys, sigma, label, cfg.stable_sigma)
    return out


def export_strand(
    sequences: DataFrame, strand: StrandConfig, stamp: str, spec: SignalSpec, cfg: AnalysisConfig
) -> None:
    """One strand's windows as Parquet and CSV, and its report, in the strand's folder."""
    own = sequences.filter(_column(spec.keys[0]) == strand.name)
    base = f"{strand.folder}/sequence_statistics_strand{strand.number}_{stamp}"
    write_parquet(own, f"{base}.parquet", mode="overwrite")
    write_csv(own, f"{base}.csv", mode="overwrite")
    report = summary_report(
        own, "MOLD_LEVEL_std [mm]", "disturbance_type", cfg.stable_sigma,
        {
            "Casting Speed [m/min]": ("CASTING_SPEED_avg [m/min]", None),
            "Mold Width [m]": ("MOLD_WIDTH_avg [m]", None),
            "SEN Depth [mm]": ("SEN_avg [mm]", None),
        },
    )
    title = f"Analysis Summary, {strand.name}"
    write_report(report, f"{strand.folder}/summary_report_{stamp}.txt", title, mode="overwrite")
