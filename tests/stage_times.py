"""Slowest stages from a Spark event log folder (as written by
``BENCH_EVENT_LOG=1 python bench.py``).

Usage: python tests/stage_times.py <event-log-dir> [top_n]
"""

from __future__ import annotations

import glob
import io
import json
import os
import sys


def _lines(path: str):
    if path.endswith(".zstd"):
        import zstandard

        with open(path, "rb") as f:
            reader = zstandard.ZstdDecompressor().stream_reader(f)
            yield from io.TextIOWrapper(reader, encoding="utf-8")
    else:
        with open(path, encoding="utf-8") as f:
            yield from f


def stages(log_dir: str) -> list[tuple[int, int, int, str]]:
    out = []
    for path in glob.glob(os.path.join(log_dir, "**", "*"), recursive=True):
        if os.path.isdir(path) or os.path.basename(path).startswith("appstatus"):
            continue
        for line in _lines(path):
            e = json.loads(line)
            if e.get("Event") == "SparkListenerStageCompleted":
                si = e["Stage Info"]
                ms = si.get("Completion Time", 0) - si.get("Submission Time", 0)
                out.append((ms, si["Stage ID"], si["Number of Tasks"], si["Stage Name"][:60]))
    return sorted(out, reverse=True)


if __name__ == "__main__":
    top = int(sys.argv[2]) if len(sys.argv) > 2 else 15
    rows = stages(sys.argv[1])
    print(f"{len(rows)} stages")
    for ms, sid, tasks, name in rows[:top]:
        print(f"{ms:8d} ms  stage {sid:4d}  tasks {tasks:5d}  {name}")
