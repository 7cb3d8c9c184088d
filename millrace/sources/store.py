"""Databases of snapshot tables.

A table is a folder of Parquet data folders and numbered manifests; the manifest with the highest
number is the table. A statement writes a new data folder and then publishes the next manifest by
renaming it into place, which fails if another writer has published that number (optimistic check).
Readers hold on to the folders of their manifest, so they see one snapshot. A transaction keeps its
manifests in memory and publishes them at COMMIT; ROLLBACK forgets them. VACUUM compacts the data
and deletes folders and manifests that no longer count. Data folders are never overwritten; UPDATE
and DELETE rewrite the files that hold a row they change and keep the others. An index is a list of
parts, each over some of the data; whatever publishes data writes parts for what no part covers, so indexes
follow every statement.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.indexes import number_rows, write_part
from millrace.sources.files import Files


class StoreError(Exception):
    """A statement that can't be done; ``kind`` names why."""

    def __init__(self, kind: str, message: str) -> None:
        super().__init__(f"{kind}: {message}")
        self.kind = kind


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.files = spark, Files(spark, root)
        self.files.make("")
        self.current: str | None = None
        self.staged: dict[tuple[str, str], dict | None] | None = None
        for d in self.databases()[:1]:
            self.current = d

    # databases

    def databases(self) -> list[str]:
        return [d for d in self.files.list("") if not d.startswith((".", "_"))]

    def create_database(self, name: str, if_not_exists: bool = False) -> None:
        if name in self.databases():
            if if_not_exists:
                return
            raise StoreError("DATABASE_EXISTS", name)
        self.files.make(name)
        self.current = self.current or name

    def drop_database(self, name: str, if_exists: bool = False) -> None:
        if name not in self.databases():
            if if_exists:
                return
            raise StoreError("DATABASE_NOT_FOUND", name)
        self.files.delete(name)
        if self.current == name:
            self.current = next(iter(self.databases()), None)

    def use(self, name: str) -> None:
        if name not in self.databases():
            raise StoreError("DATABASE_NOT_FOUND", name)
        self.current = name

    # manifests

    def _database(self) -> str:
        if self.current is None:
            raise StoreError("NO_DATABASE", "no database is selected")
        return self.current

    def _published(self, database: str, table: str) -> dict | None:
        versions = [n for n in self.files.list(f"{database}/{table}/_manifests") if n.endswith(".json")]
        if not versions:
            return None
        found = json.loads(self.files.read(f"{database}/{table}/_manifests/{versions[-1]}"))
        return None if found.get("dropped") else found

    def manifest(self, table: str, database: str | None = None) -> dict:
        database, table = database or self._database(), table.lower()
        if self.staged and (database, table) in self.staged:
            found = self.staged[database, table]
        else:
            found = self._published(database, table)
        if found is None:
            raise StoreError("TABLE_NOT_FOUND", table)
        return json.loads(json.dumps(found))

    def _index(self, table: str, manifest: dict) -> None:
        """Bring the parts of every index up to the manifest's data."""
        live = manifest["data"]
        for name, index in manifest["indexes"].items():
            parts = [p for p in index.get("parts", []) if set(p["entries"]) <= set(live)]
            covered = {e for p in parts for e in p["entries"]}
            if missing := [e for e in live if e not in covered]:
                path = f"{self._database()}/{table}/index-{name.lower()}-{uuid.uuid4().hex}"
                write_part(self._rows(table, missing, manifest), index["kind"], index["columns"], f"{self.files.root}/{path}")
                parts.append({"entries": missing, "path": path})
            index["parts"] = parts

    def index_paths(self, manifest: dict, name: str) -> list[str]:
        return [f"{self.files.root}/{p['path']}" for p in manifest["indexes"][name]["parts"]]

    def _put(self, table: str, manifest: dict) -> None:
        database, table = self._database(), table.lower()
        if not manifest.get("dropped"):
            self._index(table, manifest)
        if self.staged is not None:
            self.staged[database, table] = manifest
            return
        self._publish(database, table, manifest)

    def _publish(self, database: str, table: str, manifest: dict) -> None:
        manifest = manifest | {"version": manifest["version"] + 1}
        folder = f"{database}/{table}/_manifests"
        self.files.make(folder)
        name = f"{folder}/{manifest['version']:012d}.json"
        if not self.files.write(name, json.dumps(manifest), new=True):
            raise StoreError("CONFLICT", f"{table} was changed meanwhile")

    def begin(self) -> None:
        if self.staged is not None:
            raise StoreError("TRANSACTION", "a transaction is open already")
        self.staged = {}

    def commit(self) -> None:
        if self.staged is None:
            raise StoreError("TRANSACTION", "no transaction is open")
        staged, self.staged = self.staged, None
        for (database, table), manifest in staged.items():
            published = self._published(database, table)
            if published and published["version"] != manifest["version"]:
                raise StoreError("CONFLICT", f"{table} was changed meanwhile")
        for (database, table), manifest in staged.items():
            self._publish(database, table, manifest)

    def rollback(self) -> None:
        if self.staged is None:
            raise StoreError("TRANSACTION", "no transaction is open")
        self.staged = None

    # tables

    def tables(self) -> list[str]:
        names = [t for t in self.files.list(self._database()) if self._published(self._database(), t)]
        for (database, table), m in (self.staged or {}).items():
            if database == self.current:
                names = [n for n in names if n != table] + ([table] if m and not m.get("dropped") else [])
        return sorted(n for n in names if not n.startswith("sys_"))

    def has_table(self, table: str) -> bool:
        try:
            return not self.manifest(table).get("dropped")
        except StoreError:
            return False

    def create_table(self, table: str, columns: list[dict], checks: list[str] = (), unique: list[list[str]] = (), if_not_exists: bool = False) -> None:
        """``columns``: name, type, and not_null, auto_increment, default (SQL text) where wanted."""
        if self.has_table(table):
            if if_not_exists:
                return
            raise StoreError("TABLE_EXISTS", table)
        names = [c["name"].lower() for c in columns]
        if len(set(names)) < len(names):
            raise StoreError("DUPLICATE_COLUMN", table)
        published = self.files.list(f"{self._database()}/{table.lower()}/_manifests")
        version = int(published[-1].split(".")[0]) if published else 0
        self._put(table, {"version": version, "columns": columns, "checks": list(checks), "unique": [list(u) for u in unique], "data": [], "next_id": 1, "indexes": {}})

    def drop_table(self, table: str, if_exists: bool = False) -> None:
        if not self.has_table(table):
            if if_exists:
                return
            raise StoreError("TABLE_NOT_FOUND", table)
        self._put(table, self.manifest(table) | {"dropped": True, "data": []})

    def schema(self, table: str, manifest: dict | None = None) -> T.StructType:
        fields = [T.StructField(c["name"], self._type(c), not c.get("not_null"), {"constraints": json.dumps(c)}) for c in (manifest or self.manifest(table))["columns"]]
        return T.StructType(fields)

    @staticmethod
    def _type(column: dict) -> T.DataType:
        from millrace.functions.types import parse_type, storage_type

        return storage_type(parse_type(column["type"])[1])

    def read(self, table: str) -> DataFrame:
        m = self.manifest(table)
        if m.get("dropped"):
            raise StoreError("TABLE_NOT_FOUND", table)
        return self._rows(table, m["data"])

    def _rows(self, table: str, data: list[str], manifest: dict | None = None) -> DataFrame:
        return self.read_files(table, [f"{self.files.root}/{d}" for d in data], manifest)

    def read_files(self, table: str, paths: list[str], manifest: dict | None = None) -> DataFrame:
        bare = T.StructType([T.StructField(f.name, f.dataType, True) for f in self.schema(table, manifest)])
        if not paths:
            return self.spark.createDataFrame([], bare)
        return self.spark.read.schema(bare).parquet(*paths)

    def _write(self, table: str, df: DataFrame) -> str:
        name = f"{self._database()}/{table.lower()}/data-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(f"{self.files.root}/{name}")
        return name

    def _shaped(self, manifest: dict, df: DataFrame) -> DataFrame:
        """``df`` with the table's columns, cast; columns it lacks get their default."""
        have = {c.lower(): c for c in df.columns}
        unknown = set(have) - {c["name"].lower() for c in manifest["columns"]}
        if unknown:
            raise StoreError("COLUMN_NOT_FOUND", ", ".join(sorted(unknown)))
        out = []
        for c in manifest["columns"]:
            kind = self._type(c)
            if c["name"].lower() in have:
                value = F.col(f"`{have[c['name'].lower()]}`")
            else:
                value = F.expr(c["default"]) if c.get("default") is not None else F.lit(None)
            out.append(value.cast(kind).alias(c["name"]))
        return df.select(*out)

    def _numbered(self, manifest: dict, df: DataFrame) -> tuple[DataFrame, int]:
        auto = next((c for c in manifest["columns"] if c.get("auto_increment")), None)
        if auto is None:
            return df, manifest["next_id"]
        name, kind = auto["name"], self._type(auto)
        missing = df.filter(F.col(name).isNull())
        given = df.filter(F.col(name).isNotNull())
        top = given.agg(F.max(name)).first()[0]
        first = max(manifest["next_id"], (top or 0) + 1)
        filled = number_rows(missing, "_id", first)
        out = given.unionByName(filled.withColumn(name, F.col("_id").cast(kind)).drop("_id"))
        return out, first + missing.count()

    def _check(self, manifest: dict, new: DataFrame, rest: DataFrame | None = None) -> None:
        from millrace.functions.types import LENGTHS, RANGES, parse_type

        wrong = []
        for c in manifest["columns"]:
            name, kind = parse_type(c["type"])
            col = F.col(f"`{c['name']}`")
            if c.get("not_null"):
                wrong.append((f"{c['name']} may not be null", col.isNull()))
            if isinstance(kind, (T.VarcharType, T.CharType)):
                wrong.append((f"{c['name']} is longer than {kind.length}", F.char_length(col) > kind.length))
            if name in LENGTHS:
                wrong.append((f"{c['name']} is longer than {LENGTHS[name]}", F.char_length(col) > LENGTHS[name]))
            if name in RANGES:
                wrong.append((f"{c['name']} is out of range", ~col.between(*RANGES[name])))
        wrong += [(f"check {sql}", ~F.expr(sql)) for sql in manifest["checks"]]
        if wrong:
            counts = new.agg(*(F.count_if(F.coalesce(w, F.lit(False))).alias(f"w{i}") for i, (_, w) in enumerate(wrong))).first()
            for (what, _), n in zip(wrong, counts):
                if n:
                    raise StoreError("CONSTRAINT_VIOLATION", what)
        for keys in manifest["unique"]:
            added = new.select(keys).dropna()
            twice = added.groupBy(*keys).count().filter("count > 1").head(1)
            if twice or rest is not None and added.join(rest.select(keys), keys, "left_semi").head(1):
                raise StoreError("CONSTRAINT_VIOLATION", f"({', '.join(keys)}) must be unique")

    def insert(self, table: str, df: DataFrame, batch: int | None = None) -> int:
        """Append rows, matched by name; returns how many. A stream's ``batch`` is published with its rows,
        and one that has been published already appends nothing."""
        m = self.manifest(table)
        if batch is not None:
            if m.get("batch", -1) >= batch:
                return 0
            m["batch"] = batch
        df = self._shaped(m, df)
        if any(c.get("auto_increment") for c in m["columns"]):
            df = self._stored(staging := self._write(table, df), df)
            df, m["next_id"] = self._numbered(m, df)
        written = self._write(table, df)
        new = self._stored(written, df)
        try:
            self._check(m, new, self.read(table) if m["data"] and m["unique"] else None)
        except StoreError:
            self.files.delete(written)
            raise
        if any(c.get("auto_increment") for c in m["columns"]):
            self.files.delete(staging)
        m["data"].append(written)
        self._put(table, m)
        return new.count()

    def _stored(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(T.StructType([T.StructField(f.name, f.dataType, True) for f in like.schema])).parquet(f"{self.files.root}/{name}")

    def _replace(self, table: str, manifest: dict, df: DataFrame, kept: list[str] = ()) -> None:
        """Publish ``df`` in place of all data but ``kept`` folders and files."""
        written = self._write(table, df)
        rest = self._rows(table, list(kept)) if kept and manifest["unique"] else None
        try:
            self._check(manifest, self._stored(written, df), rest)
        except StoreError:
            self.files.delete(written)
            raise
        self._put(table, manifest | {"data": [*kept, written]})

    def _touched(self, table: str, manifest: dict, hit) -> tuple[list[str], list[str], int]:
        """Files with rows that ``hit``, folders and files without, and the number of rows."""
        found = self.read(table).filter(hit).groupBy(F.col("_metadata.file_path").alias("f")).count().collect()  # a row for each file
        names = {r["f"].rsplit("/", 2)[-2] + "/" + r["f"].rsplit("/", 1)[1] for r in found}
        touched, kept = [], []
        for entry in manifest["data"]:
            folder = entry if not entry.endswith(".parquet") else entry.rsplit("/", 1)[0]
            files = [entry] if folder != entry else [f"{entry}/{n}" for n in self.files.list(entry) if n.endswith(".parquet")]
            hit_here = [f for f in files if f.split("/", 2)[2] in names]
            touched += hit_here
            kept += [entry] if not hit_here else [f for f in files if f not in hit_here]
        return touched, kept, sum(r["count"] for r in found)

    def update(self, table: str, values: dict[str, str], where: str | None = None) -> int:
        """Set columns to SQL expressions over the old row, where the predicate is true; only files with such rows are rewritten."""
        m, df = self.manifest(table), self.read(table)
        hit = F.coalesce(F.expr(where), F.lit(False)) if where else F.lit(True)
        names = {f.name.lower(): f for f in df.schema}
        for c in values:
            if c.lower() not in names:
                raise StoreError("COLUMN_NOT_FOUND", c)
        lower = {c.lower(): v for c, v in values.items()}
        out = [F.when(hit, F.expr(lower[f.name.lower()]).cast(f.dataType)).otherwise(F.col(f"`{f.name}`")).alias(f.name) if f.name.lower() in lower else F.col(f"`{f.name}`") for f in df.schema]
        touched, kept, changed = self._touched(table, m, hit) if m["data"] else ([], [], 0)
        if changed:
            self._replace(table, m, self._rows(table, touched).select(*out), kept)
        return changed

    def delete(self, table: str, where: str | None = None) -> int:
        """Delete rows; only files with such rows are rewritten."""
        m = self.manifest(table)
        hit = F.coalesce(F.expr(where), F.lit(False)) if where else F.lit(True)
        touched, kept, gone = self._touched(table, m, hit) if m["data"] else ([], [], 0)
        if gone:
            self._replace(table, m, self._rows(table, touched).filter(~hit), kept)
        return gone

    def alter(self, table: str, columns: list[dict], select: dict[str, str]) -> None:
        """Give the table ``columns``, each computed from the old row by the SQL in ``select``."""
        m, df = self.manifest(table), self.read(table)
        new = m | {"columns": columns}
        names = {c["name"].lower() for c in columns}
        new["unique"] = [u for u in m["unique"] if all(k.lower() in names for k in u)]
        new["indexes"] = {n: i | {"parts": []} for n, i in m["indexes"].items() if all(k.lower() in names for k in i["columns"])}
        if not m["data"]:
            self._put(table, new)
            return
        self._replace(table, new, df.select(*(F.expr(select[c["name"]]).cast(self._type(c)).alias(c["name"]) for c in columns)))

    def rename_table(self, table: str, new: str) -> None:
        """The table's folder under another name; rows, counters and indexes stay."""
        if self.staged is not None:
            raise StoreError("TRANSACTION", "a table cannot be renamed in a transaction")
        if self.has_table(new):
            raise StoreError("TABLE_EXISTS", new)
        m, database = self.manifest(table), self._database()
        old, now = f"{database}/{table.lower()}/", f"{database}/{new.lower()}/"
        self.files.delete(now.rstrip("/"))
        self.files.move(old.rstrip("/"), now.rstrip("/"))
        moved = json.loads(json.dumps(m).replace(f'"{old}', f'"{now}'))
        self._publish(database, new.lower(), moved)

    def put(self, table: str, manifest: dict) -> None:
        """Publish or stage a manifest taken from ``manifest`` and changed; its indexes are brought up to date."""
        self._put(table, manifest)

    def drop_index(self, table: str, name: str) -> None:
        m = self.manifest(table)
        m["indexes"].pop(name)
        self._put(table, m)

    def vacuum(self, table: str) -> int:
        """Compact a table to one data folder and delete what no manifest needs; returns the folders deleted."""
        if self.staged is not None:
            raise StoreError("TRANSACTION", "VACUUM cannot run in a transaction")
        m = self.manifest(table)
        if len(m["data"]) > 1 or any(d.endswith(".parquet") for d in m["data"]):
            self._replace(table, m, self.read(table))
            m = self.manifest(table)
        base = f"{self._database()}/{table.lower()}"
        live, gone = {d.rsplit("/", 1)[1] for d in [*m["data"], *(p["path"] for i in m["indexes"].values() for p in i["parts"])]}, 0
        for n in self.files.list(base):
            if n.startswith(("data-", "index-")) and n not in live:
                self.files.delete(f"{base}/{n}")
                gone += 1
        for n in self.files.list(f"{base}/_manifests")[:-1]:
            self.files.delete(f"{base}/_manifests/{n}")
        return gone
