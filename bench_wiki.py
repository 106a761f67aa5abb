"""Times synchronisation and queries on a copy of a Markdown corpus: python bench_wiki.py FOLDER."""

from __future__ import annotations

import json
import os
import shutil
import statistics
import sys
import tempfile
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"
RUNS = 10


def main(corpus: str) -> None:
    from pyspark.sql import SparkSession

    from lorekeep.engine import Engine

    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    with tempfile.TemporaryDirectory() as folder:
        shutil.copytree(corpus, f"{folder}/wiki")
        engine = Engine(spark, f"{folder}/wiki", f"{folder}/projection")
        out: dict[str, float] = {}

        def timed(name: str, work, runs: int = 1):
            taken = []
            for _ in range(runs):
                start = time.perf_counter()
                result = work()
                taken.append(time.perf_counter() - start)
            out[name] = round(statistics.median(taken), 3)
            return result

        documents = timed("cold sync", engine.sync).indexed
        timed("sync without changes", engine.sync, 3)
        first = next(p for p in sorted(Path(folder, "wiki").rglob("*.md")) if p.name != "WIKI.md")
        first.write_text(first.read_text() + "\n\nchanged\n")
        timed("sync of one change", engine.sync)
        timed("validate all", engine.validate)
        engine.sync()
        for name, query in {"keyword query": {"query": "array sort"}, "filtered query": {"query": "css color", "scope": "web/css"}, "recent query": {}, "modified_desc query": {"query": "array", "order": "modified_desc"}}.items():
            timed(name, lambda query=query: engine.query(**query), RUNS)
        print(json.dumps({"documents": documents, "documents/s, cold": round(documents / out["cold sync"], 1), "seconds": out}))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1])
