"""Skew probe: the flagship scoreboard on change rows where one author holds ~40% of all rows.

Writes Spark's event log to a fresh scratch folder and prints, per stage, the number of
tasks, the max / median task time and the largest task's shuffle-read records, so a stage
that funnels the hot author into one task would stand out.

usage: python tools/skew_probe.py [sf_dir] [scoreboard|renames]

renames: every document is renamed (old/ -> new/) and about half of them become empty files,
so one content hash holds half of all rows; exact rename pairing (k-th delete with k-th add of
the same content) must not sort that group in one task.
"""

from __future__ import annotations

import glob
import json
import statistics
import sys
import tempfile
from collections import defaultdict
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from revlens.operators.stats import author_scoreboard  # noqa: E402
from revlens.session import ensure_checkpoint_dir  # noqa: E402
from revlens.sources import testdata as td  # noqa: E402


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    op = sys.argv[2] if len(sys.argv) > 2 else "scoreboard"
    log_dir = tempfile.mkdtemp(prefix="revlens-eventlog-")
    spark = (
        SparkSession.builder.master("local[8]").appName("revlens-skew-probe")
        .config("spark.sql.shuffle.partitions", "16")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "false")  # keep 16 partitions: show skew, not coalescing
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.eventLog.enabled", "true")
        .config("spark.eventLog.dir", log_dir)
        .config("spark.eventLog.compress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    if op == "renames":
        from revlens.operators.diff import exact_renames, snapshot_diff

        docs = td.table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
        content = F.when(F.col("lang").isin("en", "fr"), F.lit("")).otherwise(F.col("text"))
        name = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
        old = docs.select(F.lit("c").alias("commit_hash"), F.concat(F.lit("old/"), name).alias("path"),
                          content.alias("content"))
        new = docs.select(F.lit("c").alias("commit_hash"), F.concat(F.lit("new/"), name).alias("path"),
                          content.alias("content"))
        out = exact_renames(snapshot_diff(old, new), old, new)
        share = old.agg(F.avg((F.col("content") == "").cast("double"))).first()[0]
        counts = {r.change_type: r.n for r in out.groupBy("change_type").agg(F.count(F.lit(1)).alias("n")).collect()}
        summary = f"empty-file share: {share:.1%}; result rows by type: {counts}"
    else:
        ch = td.changes(spark, sf)
        hot = F.col("author_email").startswith("building.") | F.col("author_email").startswith("automobile.")
        skewed = ch.select(
            *[F.when(hot, F.lit("hot@example.com")).otherwise(F.col(c)).alias(c) if c == "author_email"
              else F.when(hot, F.lit("Hot Author")).otherwise(F.col(c)).alias(c) if c == "author_name"
              else F.col(c) for c in ch.columns])
        share = skewed.agg(F.avg((F.col("author_email") == "hot@example.com").cast("double"))).first()[0]
        rows = author_scoreboard(skewed).collect()
        top = rows[0]
        summary = (f"hot author share of change rows: {share:.1%}; top author {top.author_name} "
                   f"total={top.total} commits={top.commits}; authors={len(rows)}")
    spark.stop()

    tasks = defaultdict(list)
    names = {}
    for path in glob.glob(f"{log_dir}/**/*", recursive=True):
        if Path(path).is_dir():
            continue
        with open(path) as fh:
            for line in fh:
                ev = json.loads(line)
                if ev.get("Event") == "SparkListenerStageCompleted":
                    si = ev["Stage Info"]
                    names[si["Stage ID"]] = (si.get("Details") or "").split("\n")[0][:60]
                if ev.get("Event") != "SparkListenerTaskEnd":
                    continue
                info, metrics = ev["Task Info"], ev.get("Task Metrics") or {}
                dur = info["Finish Time"] - info["Launch Time"]
                read = (metrics.get("Shuffle Read Metrics") or {}).get("Total Records Read", 0)
                tasks[ev["Stage ID"]].append((dur, read))
    print(summary)
    print("stage tasks max_ms median_ms max_shuffle_records total_shuffle_records")
    for sid in sorted(tasks):
        durs = [d for d, _ in tasks[sid]]
        reads = [r for _, r in tasks[sid]]
        print(f"{sid:5d} {len(durs):5d} {max(durs):6d} {int(statistics.median(durs)):9d} "
              f"{max(reads):19d} {sum(reads):21d}  {names.get(sid, '')}")


if __name__ == "__main__":
    main()
