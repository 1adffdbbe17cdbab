"""What is known of every run, published once and read again.

Facts and findings of a run depend only on its rows, the regions and the rules.  They are
written run by run into the shared folder, under a mark made of the files that hold
the run; a later query, or a later session, builds only the runs whose mark is new.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Sequence
from functools import cache, cached_property, reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import shared_folder
from ..tables import table


@cache
def _code_mark() -> str:
    """Changes with any module of the package that what is published depends on."""
    root = Path(__file__).parent.parent
    sources = sorted(p for part in ("plans", "functions", "operators") for p in (root / part).glob("*.py"))
    return hashlib.sha256(b"".join(p.read_bytes() for p in sources)).hexdigest()[:16]


def of_runs(run: Column, tags: Sequence[str | None]) -> Column:
    known = [t for t in tags if t is not None]
    return run.isin(*known) | run.isNull() if None in tags else run.isin(*known)


class RunStore:
    """Tables with a column ``run_tag``, kept per run under ``spark.checkpoint.dir``."""

    def __init__(self, spark: SparkSession, folder: str, rows: str = "snapshots", others: Sequence[str] = ("district_boundaries",)) -> None:
        self.spark, self.folder, self.rows, self.others = spark, folder, rows, others
        self.base = f"{shared_folder(spark)}/strataquay-runs"

    def _files(self, name: str, *keys: str) -> DataFrame:
        """Per key the rows and a sum over the files that hold them: path, size and time of change; one narrow scan."""
        mark = F.xxhash64("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").cast("decimal(38,0)")
        return table(self.spark, self.folder, name).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(mark).alias("files"))

    @cached_property
    def marks(self) -> dict[str | None, str]:
        """A mark for every run; one row a run comes to the driver."""
        around = [str(self._files(name).first()) for name in self.others]
        return {
            r["run_tag"]: hashlib.sha256("|".join([_code_mark(), self.folder, *around, str(r)]).encode()).hexdigest()[:32]
            for r in self._files(self.rows, "run_tag").collect()
        }

    def _hadoop(self, path: str):
        made = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return made.getFileSystem(self.spark._jsc.hadoopConfiguration()), made

    def _published(self, kind: str) -> dict[str, str]:
        """Marks and the folder each is published in."""
        system, pattern = self._hadoop(f"{self.base}/{kind}/*/_runs/*")
        found = system.globStatus(pattern) or []
        return {s.getPath().getName(): s.getPath().getParent().getParent().toString() for s in found}

    def read(self, kind: str, build: Callable[[list[str | None]], DataFrame]) -> DataFrame:
        """The table ``kind`` of all runs; ``build`` makes that of the runs which aren't published yet."""
        known = self._published(kind)
        missing = [tag for tag, mark in self.marks.items() if mark not in known]
        if missing or not self.marks:
            path = f"{self.base}/{kind}/{uuid.uuid4().hex}"
            made = build(missing)
            # the marks are set when all is written: a broken run leaves nothing that is read
            made.write.partitionBy("run_tag").parquet(path)
            system, _ = self._hadoop(path)
            for name in ("_schema", *[f"_runs/{self.marks[t]}" for t in missing]):
                out = system.create(self._hadoop(f"{path}/{name}")[1], True)
                if name == "_schema":
                    out.write(made.schema.json().encode())
                out.close()
            if not self.marks:
                return made
            known |= {self.marks[t]: path for t in missing}
        places: dict[str, list[str | None]] = {}
        for tag, mark in self.marks.items():
            places.setdefault(known[mark], []).append(tag)
        parts = [self._part(place, tags) for place, tags in sorted(places.items(), key=lambda p: p[0])]
        return reduce(DataFrame.unionByName, parts)

    def _part(self, place: str, tags: list[str | None]) -> DataFrame:
        system, path = self._hadoop(f"{place}/_schema")
        stream = system.open(path)
        try:
            schema = StructType.fromJson(json.loads(bytes(stream.readAllBytes()).decode()))
        finally:
            stream.close()
        return self.spark.read.schema(schema).parquet(place).where(of_runs(F.col("run_tag"), tags)).select(*schema.fieldNames())
