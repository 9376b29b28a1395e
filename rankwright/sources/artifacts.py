"""Stage artifacts, addressed by the digest of what made them.

An artifact's name holds the digest of its parameters, of this library's code and of its inputs (paths, sizes and times of all files),
so that a stage whose inputs and parameters are unchanged is read and not built again, by any later query or application. It is built beside
its place and published by one rename: readers see all of it or nothing, a failed or gated build publishes nothing, and of two
builders the first wins. What nobody has used for a while is swept.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
import uuid
from collections.abc import Callable, Mapping, Sequence
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

import rankwright
from rankwright.operators.quality import digest
from rankwright.sources import hadoop, shared_dir

#: A file whose time is that of the artifact's last use.
USED = "_used"


def fingerprint(spark: SparkSession, paths: Sequence[str]) -> list:
    """Count and digest of the files under ``paths``; their contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    return [str(x) for x in digest(files.select("path", "length", "modificationTime")).first()]


@cache
def code() -> str:
    """Digest of the library's own modules: other code, other artifacts."""
    root, out = Path(rankwright.__file__).parent, hashlib.sha256()
    for part in ("functions", "operators", "plans", "sources"):
        for file in sorted((root / part).glob("*.py")):
            out.update(f"{part}/{file.name}".encode() + file.read_bytes())
    return out.hexdigest()


class Artifacts:
    """The artifacts in one folder, ``artifacts`` in the shared one by default."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, root or f"{shared_dir(spark)}/artifacts"

    def address(self, name: str, inputs: Sequence[str], params: Mapping) -> str:
        told = json.dumps([code(), name, params, fingerprint(self.spark, inputs)], sort_keys=True, default=str)
        return f"{self.root}/{name}-{hashlib.sha256(told.encode()).hexdigest()[:32]}"

    def get(self, name: str, inputs: Sequence[str], params: Mapping, build: Callable[[], DataFrame]) -> DataFrame:
        """The artifact of (name, inputs, params): read if it is there, else built and published."""
        path = self.address(name, inputs, params)
        fs, where = hadoop(self.spark, path)
        if not fs.exists(where):
            building = f"{self.root}/.{name}-{uuid.uuid4().hex}"
            try:
                build().write.parquet(building)
                self._publish(building, path)
            finally:
                fs.delete(hadoop(self.spark, building)[1], True)
        used = hadoop(self.spark, f"{path}/{USED}")[1]
        fs.create(used, True).close()
        return self.spark.read.parquet(path)

    def _publish(self, building: str, path: str) -> None:
        fs = self.spark._jvm.org.apache.hadoop.fs
        files, there = hadoop(self.spark, path)
        here = fs.Path(building)
        # unlike the file system's own, this rename fails where there is something already
        context = fs.FileContext.getFileContext(files.getUri(), files.getConf())
        none = self.spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 0)
        try:
            context.rename(here, there, none)
        except Exception as failed:
            # somebody else has published the same artifact meanwhile
            if not files.exists(there):
                raise failed

    def sweep(self, unused_for: float) -> list[str]:
        """Delete artifacts, and unfinished builds, that have not been used for so many seconds; their names."""
        fs, root = hadoop(self.spark, self.root)
        gone = []
        for at in fs.listStatus(root) if fs.exists(root) else ():
            name = at.getPath().getName()
            used = hadoop(self.spark, f"{at.getPath()}/{USED}")[1]
            last = (fs.getFileStatus(used) if fs.exists(used) else at).getModificationTime() / 1000
            if re.search("-[0-9a-f]{32}$", name) and time.time() - last >= unused_for:
                fs.delete(at.getPath(), True)
                gone.append(name)
        return gone
