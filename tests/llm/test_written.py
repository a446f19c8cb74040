"""What a written step leaves on disk."""

import time

from basketry.llm import quality
from basketry.llm.common import written


def test_written_tables_leave_no_shuffle_files(spark):
    def files() -> int:
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return sum(str(found.apply(i).getName()).startswith("shuffle") for i in range(found.size()))

    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was, before = spark.conf.get(setting), files()
    rows = spark.range(0, 50_000, 1, 4).repartition(7)
    table = written(rows)
    until = time.time() + 10
    while files() > before and time.time() < until:
        time.sleep(0.2)
    assert files() <= before
    assert table.count() == 50_000
    assert spark.conf.get(setting) == was


def test_what_a_fit_took_of_the_drivers_memory_is_given_back(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(quality.ts, "released", lambda: calls.append(1))
    rows = [(i, i % 2, ("good plain words here " if i % 2 else "zz qq ") * 5) for i in range(40)]
    quality.fit(spark.createDataFrame(rows, "__k long, __y int, __text string"))
    assert calls
