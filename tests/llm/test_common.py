"""What the operators share."""

import re
from pathlib import Path

from quillgraph.llm.common import cut


def anonymous_mb(pid):
    return int(re.search(r"\nAnonymous:\s+(\d+)", Path(f"/proc/{pid}/smaps_rollup").read_text())[1]) / 1024


def test_cut_returns_the_drivers_free_memory(spark):
    """Freed memory outside the heap stays in the C library's arenas, between what is still in use."""
    jvm = spark.sparkContext._jvm
    pid = jvm.java.lang.ProcessHandle.current().pid()
    cut(spark.range(1))
    made = [jvm.java.util.zip.Deflater() for _ in range(800)]
    for i, d in enumerate(made):
        if i % 8:
            d.end()
    for _ in range(2):  # so that the heap has its size
        jvm.System.gc()
    before = anonymous_mb(pid)
    cut(spark.range(1))
    after = anonymous_mb(pid)
    for d in made[::8]:
        d.end()
    assert before - after > 50
