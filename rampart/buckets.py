"""Tables in buckets with a manifest: a commit writes the buckets that it touches, then names them all in one new file.

Below a folder: `data/NAME/v=W/b=B` holds bucket B of table NAME as write W left it, and `manifest/V.json` says for every
table which write each bucket is read from. Writes of commit V are numbered from V x WRITES on, so none touches another's files. A reader takes the newest manifest, so it sees all of a commit or nothing of
it. Manifests are put in place by a rename that fails where the name is taken, so of two writers of one version one fails.
Versions that no kept manifest names are removed by vacuum. A manifest has tables x BUCKETS numbers; only it and bucket
numbers reach the driver.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS, WRITES = 64, 1000


@dataclass
class Manifest:
    version: int = -1
    tag: int = -1  # what the writer calls the commit, such as a micro-batch
    schemas: dict[str, dict] = field(default_factory=dict)
    versions: dict[str, dict[str, int]] = field(default_factory=dict)  # writes by table and bucket


class Buckets:
    """The tables of a folder. keys: the column of each table that decides a row's bucket."""

    def __init__(self, spark: SparkSession, folder: str, keys: dict[str, str], buckets: int = BUCKETS):
        self.spark, self.folder, self.keys, self.n = spark, folder.rstrip("/"), keys, buckets
        self.written = 0  # buckets that the last commit wrote

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *parts)))

    def _fs(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, *parts: str) -> list[str]:
        fs, at = self._fs(), self._path(*parts)
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def manifests(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names("manifest") if n.endswith(".json") and not n.startswith((".", "_")))

    def manifest(self, version: int | None = None) -> Manifest:
        """The newest manifest, or that of a version; an empty one where there is none."""
        found = self.manifests()
        if version is None and not found:
            return Manifest()
        stream = self._fs().open(self._path("manifest", f"{found[-1] if version is None else version}.json"))
        try:
            return Manifest(**json.loads(bytes(stream.readAllBytes()).decode()))
        finally:
            stream.close()

    def bucket(self, column: str | Column) -> Column:
        column = F.col(column) if isinstance(column, str) else column
        return F.pmod(F.xxhash64(column.cast("string")), F.lit(self.n)).cast("int")

    def touched(self, values: DataFrame, column: str) -> list[int]:
        """The buckets of a column's values: BUCKETS numbers at most."""
        return sorted(r.b for r in values.select(self.bucket(column).alias("b")).distinct().collect())

    def read(self, name: str, buckets: list[int] | None = None, version: int | None = None) -> DataFrame:
        """A table, or some of its buckets; files of other buckets aren't opened."""
        return self._read(self.manifest(version), name, buckets)

    def _read(self, m: Manifest, name: str, buckets: list[int] | None) -> DataFrame:
        schema = T.StructType.fromJson(m.schemas[name])
        wanted = m.versions.get(name, {}) if buckets is None else {b: v for b, v in m.versions.get(name, {}).items() if int(b) in set(buckets)}
        paths = [f"{self.folder}/data/{name}/v={v}/b={b}" for b, v in wanted.items()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def draft(self, tag: int | None = None) -> Draft | None:
        """A commit to be made; None if one of this tag, or a later one, has been made already."""
        old = self.manifest()
        return None if tag is not None and tag <= old.tag else Draft(self, old, old.tag if tag is None else tag)

    def commit(self, changes: dict[str, tuple[DataFrame, list[int] | None]], tag: int | None = None) -> Manifest:
        """Put in place changes(rows, buckets) by table, as `Draft.put` takes them; nothing if the tag has been committed."""
        own = self.draft(tag)
        if own is None:
            return self.manifest()
        for name, (df, buckets) in changes.items():
            own.put(name, df, buckets)
        return own.publish()

    def _put(self, m: Manifest) -> None:
        fs, jvm = self._fs(), self.spark._jvm
        fs.mkdirs(self._path("manifest"))
        draft, place = self._path("manifest", f"_{m.version}.draft"), self._path("manifest", f"{m.version}.json")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(vars(m)).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        kinds = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context.rename(draft, place, kinds)  # fails where the manifest is there already

    def vacuum(self, keep: int = 1) -> int:
        """Remove manifests but the newest `keep`, and versions that none of them names; how many folders went."""
        kept, fs, gone = self.manifests()[-keep:], self._fs(), 0
        used = {(name, v, b) for m in map(self.manifest, kept) for name, own in m.versions.items() for b, v in own.items()}
        for version in self.manifests()[:-keep]:
            fs.delete(self._path("manifest", f"{version}.json"), False)
        newest = kept[-1] if kept else -1
        for name in self._names("data"):
            for v in self._names("data", name):
                number = int(v.removeprefix("v="))
                if number // WRITES > newest:
                    continue  # a commit that hasn't ended
                own = [b for b in self._names("data", name, v) if b.startswith("b=")]
                unused = [b for b in own if (name, number, b.removeprefix("b=")) not in used]
                gone += len(unused)
                for b in unused if len(unused) < len(own) else [""]:
                    fs.delete(self._path("data", name, v, b) if b else self._path("data", name, v), True)
        return gone


class Draft:
    """A commit in the making: tables that it has put can be read from it; nobody else sees them before it is published."""

    def __init__(self, store: Buckets, old: Manifest, tag: int):
        self.store = store
        self.manifest = Manifest(old.version + 1, tag, dict(old.schemas), {k: dict(v) for k, v in old.versions.items()})
        self.writes = 0
        store.written = 0

    def put(self, name: str, df: DataFrame, buckets: list[int] | None = None) -> None:
        """Write a table's rows: all that these buckets hold from now on; None: all buckets. Rows of other buckets are left out."""
        s, m = self.store, self.manifest
        write = m.version * WRITES + self.writes
        self.writes += 1
        rows = df.withColumn("b", s.bucket(s.keys[name]))
        own = range(s.n) if buckets is None else buckets
        if own:
            rows = rows if buckets is None else rows.where(F.col("b").isin(*own))
            rows.repartition(min(len(own), s.n), "b").write.mode("overwrite").partitionBy("b").parquet(f"{s.folder}/data/{name}/v={write}")
        made = {n.removeprefix("b=") for n in s._names("data", name, f"v={write}") if n.startswith("b=")} if own else set()
        s.written += len(made)
        m.schemas[name] = df.schema.jsonValue()
        kept = {b: v for b, v in m.versions.get(name, {}).items() if int(b) not in set(own)}
        m.versions[name] = kept | dict.fromkeys(sorted(made, key=int), write)

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        return self.store._read(self.manifest, name, buckets)

    def publish(self) -> Manifest:
        self.store._put(self.manifest)
        return self.manifest
