"""What the operators share."""

import re
from pathlib import Path

from webextract.llm import common


def held(spark):
    """MB of the driver's JVM without mapped files, as the check tool counts them."""
    pid = spark._jvm.java.lang.ProcessHandle.current().pid()
    return sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", Path(f"/proc/{pid}/smaps_rollup").read_text()))) / 1024


def test_steps_return_the_drivers_freed_memory(spark, monkeypatch):
    field = spark._jvm.java.lang.Class.forName("sun.misc.Unsafe").getDeclaredField("theUnsafe")
    field.setAccessible(True)
    unsafe, docs = field.get(None), spark.range(10)
    space = common.Workspace(spark)
    common.cut(docs), space.save(docs, "before")  # so that later steps need no new memory of their own
    for name, step in (("cut", lambda: common.cut(docs)), ("save", lambda: space.save(docs, "after"))):
        blocks = [unsafe.allocateMemory(100_000) for _ in range(4000)]
        for x in blocks:
            unsafe.setMemory(x, 100_000, 1)
        # Every 16th block stays, so the allocator can't return the others by itself.
        for x in [x for i, x in enumerate(blocks) if i % 16]:
            unsafe.freeMemory(x)
        before = held(spark)
        monkeypatch.setattr(common, "_trimmed", -1e9, raising=False)
        step()
        after = held(spark)
        for x in blocks[::16]:
            unsafe.freeMemory(x)
        assert before - after > 200, name
    space.drop()


def test_a_jvm_that_cannot_return_memory_goes_on(spark, monkeypatch):
    from py4j.protocol import Py4JError

    class Jvm:
        def __getattr__(self, name):
            raise Py4JError(name)

    class Session:
        sparkContext = spark.sparkContext
        _jvm = Jvm()

    monkeypatch.setattr(common, "_trimmed", -1e9)
    common.trim_driver(Session())
    monkeypatch.setattr(common, "_trimmed", -1e9)
    assert common.cut(spark.range(3)).count() == 3
