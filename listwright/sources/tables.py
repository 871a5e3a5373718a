"""Stored tables: buckets of a key, small layers per run, one exclusive commit per run."""

from __future__ import annotations

import json
import time
import uuid
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from listwright import schemas

#: Buckets of a keyed table, and layers of one bucket before a compaction writes it anew.
BUCKETS, LAYERS = 64, 8


class Conflict(RuntimeError):
    """Another run was committed since this one began."""


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """No rows of a schema; Catalyst sees that there are none."""
    return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema).fields])


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


class Store:
    """Parquet tables under one root, read through the newest commit.

    A keyed table (``schemas.KEYS``) is dealt into hash buckets of its first key column; other tables have one bucket. What a run writes to a
    table is one folder, a layer, with a part for each bucket it touches. The table's manifest names the layers of every bucket, oldest
    first, and a commit names the manifests in force. So a run writes in proportion to its rows, a reader that needs some keys opens the
    folders of their buckets only, and runs that were lost or never committed are in no manifest.

    In a snapshot (``upsert``, ``write_snapshot``) the newest layer that holds a key replaces the key's older rows; a history (``append``)
    is all its layers. ``compact`` writes buckets of many layers as one layer, as a run of its own.

    The commit file is put in place by a rename that fails if the number is taken: of two runs that began at one commit the second
    raises ``Conflict`` and has to be repeated on the newer tables. There is nothing else to release, so a lost run blocks nobody. Where
    a file system has no such rename, as on object stores, let one run at a time write.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS) -> None:
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    # Files

    def _path(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _names(self, *parts: str) -> list[str]:
        fs, folder = self._path(*parts)
        return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []

    def _read_json(self, *parts: str):
        fs, path = self._path(*parts)
        stream = fs.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _write_text(self, text: str, *parts: str) -> None:
        fs, path = self._path(*parts)
        stream = fs.create(path, True)
        stream.write(bytearray(text.encode()))
        stream.close()

    def _rename_new(self, source: str, target: str) -> bool:
        """Moves a file unless the target exists."""
        jvm = self.spark._jvm
        _, a = self._path("_commits", source)
        fs, b = self._path("_commits", target)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        try:
            context.rename(a, b, options)
        except Exception:
            if self._names("_commits").count(target):
                return False
            raise
        return True

    # Commits

    def newest(self) -> int:
        """The number of the newest commit, 0 if there is none."""
        return max((int(n[:-5]) for n in self._names("_commits") if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def commits(self) -> list[tuple[int, str]]:
        """(number, run id), oldest first."""
        return [(n, self._read_json("_commits", f"{n:010d}.json")["run"]) for n in range(1, self.newest() + 1)]

    def is_committed(self, run_id: str) -> bool:
        """Looks at the numbers the run tried to commit, not at all commits."""
        tried = [int(n) for n in self._names("_runs", quote(run_id, safe=""))]
        last = self.newest()
        return any(n <= last and self._read_json("_commits", f"{n:010d}.json")["run"] == run_id for n in tried)

    def _manifests(self) -> dict[str, str]:
        number = self.newest()
        return self._read_json("_commits", f"{number:010d}.json")["tables"] if number else {}

    def manifest(self, name: str, at: str | None = None) -> dict:
        """``buckets``, ``layers`` (folder, buckets written) and ``live`` (per bucket the places of its layers, oldest first)."""
        at = at or self._manifests().get(name)
        if at:
            return self._read_json(name, "_manifests", at)
        n = self.buckets if name in schemas.KEYS else 1
        return {"buckets": n, "layers": [], "live": [[] for _ in range(n)]}

    def begin(self, run_id: str) -> Run:
        return Run(self, run_id)

    # Single tables

    def write_snapshot(self, name: str, df: DataFrame) -> None:
        """A snapshot as a run of its own."""
        with self.begin(f"{name}-{uuid.uuid4().hex}") as run:
            run.write_snapshot(name, df)

    def append(self, name: str, df: DataFrame, run_id: str) -> None:
        """Rows of a history as a run of its own; nothing happens if the run is committed already."""
        if not self.is_committed(run_id):
            with self.begin(run_id) as run:
                run.append(name, df)

    # Reading

    def _folders(self, name: str, manifest: dict, wanted: list[tuple[int, int]]) -> list[str]:
        """Paths of (layer, bucket) pairs, a layer's own folder where all its buckets are wanted."""
        by_layer: dict[int, list[int]] = {}
        for layer, bucket in wanted:
            by_layer.setdefault(layer, []).append(bucket)
        paths = []
        for layer, own in sorted(by_layer.items()):
            folder, written = manifest["layers"][layer]
            base = f"{self.root}/{name}/{folder}"
            paths += [base] if len(own) == written else [f"{base}/bucket={b}" for b in sorted(own)]
        return paths

    def _read(self, name: str, schema, paths: list[str]) -> DataFrame:
        rows = self.spark.read.schema(schema).option("basePath", f"{self.root}/{name}").parquet(*paths)
        return rows.withColumn("_at", F.substring("at", 1, 10).cast("long")).drop("at", "bucket")

    def read_snapshot(self, name: str, schema, buckets: list[int] | None = None, at: str | None = None) -> DataFrame:
        """The rows in force, of some buckets or all; an empty table if nothing was written.

        Buckets of one layer are read as they are. In others the newer layers say which keys they replace: the keys of the newer
        layers alone are aggregated, and the rows join them.
        """
        manifest = self.manifest(name, at)
        live = [(b, manifest["live"][b]) for b in (range(manifest["buckets"]) if buckets is None else buckets)]
        calm = [(layers[0], b) for b, layers in live if len(layers) == 1]
        base = [(layers[0], b) for b, layers in live if len(layers) > 1]
        newer = [(x, b) for b, layers in live for x in layers[1:]]
        columns = StructType.fromDDL(schema).names
        parts = []
        if calm:
            parts.append(self._read(name, schema, self._folders(name, manifest, calm)).select(*columns))
        if newer:
            key = schemas.KEYS[name]
            read = lambda pairs: self._read(name, schema, self._folders(name, manifest, pairs))
            last = read(newer).groupBy(*key).agg(F.max("_at").alias("_last"))
            rows = read(base).unionByName(read(newer)).join(last, key, "left")
            parts.append(rows.where(F.col("_last").isNull() | (F.col("_at") == F.col("_last"))).select(*columns))
        if not parts:
            return empty(self.spark, schema)
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def read_history(self, name: str, schema, buckets: list[int] | None = None, at: str | None = None) -> DataFrame:
        """Rows of all committed runs, of some buckets or all."""
        manifest = self.manifest(name, at)
        pairs = [(layer, b) for b in (range(manifest["buckets"]) if buckets is None else buckets) for layer in manifest["live"][b]]
        columns = StructType.fromDDL(schema).names
        return self._read(name, schema, self._folders(name, manifest, pairs)).select(*columns) if pairs else empty(self.spark, schema)

    def touched(self, name: str, keys: DataFrame) -> list[int]:
        """The buckets of the rows of ``keys`` (first key column of the table): a list of at most as many numbers as there are buckets."""
        n = self.manifest(name)["buckets"]
        key = schemas.KEYS[name][0]
        return sorted(r[0] for r in keys.select(bucket_of(F.col(key), n)).distinct().collect())

    def with_run_time(self, rows: DataFrame) -> DataFrame:
        """Adds ``run_at``, when the row's run was finished; NULL for rows of no completed run."""
        runs = self.read_history("runs", schemas.RUNS).where("status = 'completed'")
        return rows.join(runs.select("run_id", F.col("finished_at").alias("run_at")), "run_id", "left")

    # Upkeep

    def compact(self, layers: int = LAYERS, run_id: str | None = None) -> dict[str, int]:
        """Writes every bucket of more than ``layers`` layers as one layer; the number of buckets written, by table.

        Other buckets are left alone, so the work follows what runs have touched. Readers of older commits keep their files.
        """
        done = {}
        with self.begin(run_id or f"compact-{uuid.uuid4().hex}") as run:
            for name, at in run.tables.items():
                manifest = self.manifest(name, at)
                full = [b for b, live in enumerate(manifest["live"]) if len(live) > layers]
                if full:
                    schema = schemas.TABLES[name]
                    read = self.read_snapshot if name in schemas.SNAPSHOTS else self.read_history
                    run.replace_buckets(name, read(name, schema, full, at), full)
                    done[name] = len(full)
        return done

    def vacuum(self, hours: float = 24.0 * 7) -> int:
        """Removes layers that no manifest in force names and that are older than ``hours``: those of lost or repeated runs and those that
        compactions and new snapshots replaced. Give readers of older commits at least that long. Returns the number of folders removed."""
        limit, removed = (time.time() - hours * 3600) * 1000, 0
        for name, at in self._manifests().items():
            named = {folder for folder, _ in self.manifest(name, at)["layers"]}
            fs, base = self._path(name)
            for status in fs.listStatus(base):
                folder = status.getPath().getName()
                if folder.startswith("at=") and folder not in named and status.getModificationTime() < limit:
                    removed += bool(fs.delete(status.getPath(), True))
        return removed


class Run:
    """Writes of one run; used as a context, it commits at the end unless an error occurred."""

    def __init__(self, store: Store, run_id: str) -> None:
        self.store, self.run_id = store, run_id
        self.number = store.newest() + 1
        self.tables = store._read_json("_commits", f"{self.number - 1:010d}.json")["tables"] if self.number > 1 else {}

    def _layer(self, name: str, df: DataFrame, manifest: dict) -> tuple[list, list[int]]:
        """Writes a folder of its own; (folder, number of buckets) and the buckets. Rebalancing splits a bucket of many rows and puts
        small ones together, so neither a hot key nor a small batch makes its own number of tasks."""
        folder, key, n = f"at={self.number:010d}-{uuid.uuid4().hex}", schemas.KEYS.get(name), manifest["buckets"]
        bucket = bucket_of(F.col(key[0]), n) if key else F.lit(0)
        placed = df.withColumn("bucket", bucket)
        placed = placed.hint("rebalance", "bucket") if key else placed
        writer = placed.write.partitionBy("bucket").mode("overwrite")
        for column in schemas.LOOKUPS.get(name, []):
            # As large as the rows of a file need; the fixed size would be a megabyte a file.
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
        writer.parquet(f"{self.store.root}/{name}/{folder}")
        buckets = [int(f[7:]) for f in self.store._names(name, folder) if f.startswith("bucket=")]
        return [folder, len(buckets)], buckets

    def _add(self, name: str, df: DataFrame, replaced: list[int] | None) -> None:
        manifest = self.store.manifest(name, self.tables.get(name))
        layer, written = self._layer(name, df, manifest)
        live = [[] if replaced is not None and b in set(replaced) else old for b, old in enumerate(manifest["live"])]
        layers = [*manifest["layers"], layer]
        live = [[*old, len(layers) - 1] if b in set(written) else old for b, old in enumerate(live)]
        used = sorted({x for own in live for x in own})
        place = {x: i for i, x in enumerate(used)}
        text = json.dumps({"buckets": manifest["buckets"], "layers": [layers[x] for x in used], "live": [[place[x] for x in own] for own in live]})
        self.tables[name] = f"{self.number:010d}-{uuid.uuid4().hex}.json"
        self.store._write_text(text, name, "_manifests", self.tables[name])

    def write_snapshot(self, name: str, df: DataFrame) -> None:
        """The whole table anew."""
        self._add(name, df, list(range(self.store.manifest(name, self.tables.get(name))["buckets"])))

    def upsert(self, name: str, df: DataFrame) -> None:
        """Rows that replace all stored rows of their keys."""
        self._add(name, df, None)

    def replace_buckets(self, name: str, df: DataFrame, buckets: list[int]) -> None:
        """All rows of some buckets anew."""
        self._add(name, df, buckets)

    def append(self, name: str, df: DataFrame) -> None:
        self._add(name, df, None)

    def commit(self) -> None:
        number = f"{self.number:010d}"
        # The run notes the number it tries before it takes it, so that its own commit is found without reading all others.
        self.store._write_text("", "_runs", quote(self.run_id, safe=""), number)
        draft = f".{number}-{uuid.uuid4().hex}"
        self.store._write_text(json.dumps({"run": self.run_id, "tables": self.tables}), "_commits", draft)
        if not self.store._rename_new(draft, f"{number}.json"):
            other = self.store._read_json("_commits", f"{number}.json")["run"]
            raise Conflict(f"run {other} was committed meanwhile; repeat run {self.run_id}")

    def __enter__(self) -> Run:
        return self

    def __exit__(self, error, *_) -> None:
        if error is None:
            self.commit()


def insert_if_absent(stored: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Incoming rows whose key is not stored yet; the first of several alike."""
    fresh = incoming.join(stored.select(*key).distinct(), key, "left_anti")
    rest = [c for c in incoming.columns if c not in key]
    first = fresh.groupBy(*key).agg(F.min(F.struct(*rest)).alias("r")) if rest else fresh.select(*key).distinct()
    return first.select(*key, "r.*") if rest else first


def seed_fees(stored: DataFrame, incoming: DataFrame, marketplaces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fee rows to add, rows skipped because their marketplace is unknown)."""
    slugs = marketplaces.select(F.col("slug").alias("marketplace"))
    known = incoming.join(slugs, "marketplace", "left_semi")
    skipped = incoming.join(slugs, "marketplace", "left_anti")
    return insert_if_absent(stored, known, ["marketplace", "category", "fee_type", "effective_date"]), skipped


def dimension(store: Store, name: str) -> DataFrame:
    """A stored dimension: ``marketplaces``, ``fees`` or ``sources``."""
    return store.read_history(name, schemas.TABLES[name])


def seed_dimensions(store: Store, run_id: str, marketplaces: DataFrame | None = None, fees: DataFrame | None = None, sources: DataFrame | None = None) -> DataFrame:
    """Stores the dimension rows whose keys are not stored yet, as one run; the fee rows skipped because their marketplace is unknown.

    Marketplaces are told apart by slug, sources by name, fees by marketplace, category, fee type and effective date.
    """
    fitted = lambda name, df: df.select(*[F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name)
                                          for f in StructType.fromDDL(schemas.TABLES[name]).fields])
    skipped = empty(store.spark, schemas.FEES)
    if store.is_committed(run_id):
        return skipped
    with store.begin(run_id) as run:
        places = dimension(store, "marketplaces")
        if marketplaces is not None:
            added = insert_if_absent(places, fitted("marketplaces", marketplaces), ["slug"])
            run.append("marketplaces", added)
            places = places.unionByName(added)
        if sources is not None:
            run.append("sources", insert_if_absent(dimension(store, "sources"), fitted("sources", sources), ["name"]))
        if fees is not None:
            added, skipped = seed_fees(dimension(store, "fees"), fitted("fees", fees), places)
            run.append("fees", added)
    return skipped


def run_by_id(runs: DataFrame, run_id: str) -> DataFrame:
    return runs.where(F.col("run_id") == run_id)


def newest_runs(runs: DataFrame, limit: int = 25) -> DataFrame:
    return runs.orderBy(F.col("created_at").desc(), F.col("run_id").desc()).limit(limit)


def source_freshness(products: DataFrame, as_of) -> DataFrame:
    """Rows and newest collection time per source, with its age in hours to one decimal."""
    rows = products.groupBy("source_name").agg(F.count(F.lit(1)).alias("products"), F.max("collected_at").alias("newest"))
    hours = (F.unix_micros(as_of) - F.unix_micros("newest")) / 3_600_000_000.0
    return rows.withColumn("age_hours", F.floor(hours * 10 + 0.5).cast("double") / 10)


def last_completed_run(runs: DataFrame, sources: DataFrame) -> DataFrame:
    done = runs.where(F.col("status") == "completed").agg(F.max_by(F.struct("run_id", "finished_at", "data_source_id"), F.struct("finished_at", "run_id")).alias("r"))
    named = sources.select("data_source_id", F.col("name").alias("source"))
    return done.select("r.*").join(named, "data_source_id", "left").select("run_id", "finished_at", F.coalesce("source", F.lit("unknown")).alias("source"))
