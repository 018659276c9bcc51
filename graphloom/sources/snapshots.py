"""Versioned tables with named refs.

A snapshot is a set of tables, written first, each as files of their own. What
exists is said by numbered manifests alone: a publication writes the next one
beside its place and moves it there, which fails if another one has that number,
so a reader sees all of a snapshot or none of it, and a write that is lost leaves
every ref as it was. Two writers at once are told apart, and the later one goes again
on top of the other. A manifest that can't be read or has another format counts as empty.

Everything goes through the file systems that Spark knows. Manifests hold names and
paths, no data.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

FORMAT = 1
#: What is said of a snapshot without metadata.
UNKNOWN = {"commit": "unknown", "author": "unknown", "email": "", "date": "", "message": ""}


class Store:
    """Tables under ``path``, by ref. ``main~2`` is the snapshot two publications before that of ``main``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, *parts: str) -> Any:
        return self._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def _fs(self) -> Any:
        return self._path().getFileSystem(self._conf)

    def _last(self) -> int:
        """The highest number of a manifest, or 0."""
        folder = self._path("manifests")
        if not self._fs().exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._fs().listStatus(folder)]
        return max([0, *(int(m[1]) for n in names if (m := re.fullmatch(r"(\d+)\.json", n)))])

    def manifest(self) -> dict:
        number = self._last()
        empty = {"format": FORMAT, "number": number, "refs": {}, "snapshots": {}}
        if not number:
            return empty
        text = self.spark.read.text(f"{self.path}/manifests/{number}.json", wholetext=True).first()
        try:
            found = json.loads(text[0]) if text else None
        except json.JSONDecodeError:
            return empty
        sound = isinstance(found, dict) and found.get("format") == FORMAT and isinstance(found.get("refs"), dict) and isinstance(found.get("snapshots"), dict)
        return found | {"number": number} if sound else empty

    def _move(self, manifest: dict) -> bool:
        """Whether ``manifest`` is now the one after its number."""
        target = self._path("manifests", f"{manifest['number'] + 1}.json")
        made = self._path("manifests", f"_{uuid.uuid4().hex}.json")
        out = self._fs().create(made)
        out.write(json.dumps({k: v for k, v in manifest.items() if k != "number"}).encode())
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(made.toUri(), self._conf)
        how = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(made, target, how)
        except Exception as e:  # the number is taken; anything else goes on
            if "FileAlreadyExists" not in str(e):
                raise
            self._fs().delete(made, False)
            return False
        return True

    def _changed(self, change: Callable[[dict], None], tries: int = 20) -> None:
        for _ in range(tries):
            now = self.manifest()
            change(now)
            if self._move(now):
                return
        raise RuntimeError(f"{self.path}: other writers were faster {tries} times")

    def publish(self, ref: str, tables: dict[str, DataFrame], meta: dict[str, str] | None = None, append: bool = False) -> str:
        """Write ``tables`` and let ``ref`` name them; with ``append`` beside the rows that it names already. Returns the snapshot's id."""
        new = uuid.uuid4().hex
        for name, table in tables.items():
            table.write.parquet(f"{self.path}/data/{new}/{name}")

        def change(now: dict) -> None:
            parent = now["refs"].get(ref)
            before = now["snapshots"][parent]["tables"] if append and parent else {}
            held = {name: [*before.get(name, []), f"data/{new}/{name}"] for name in tables}
            now["snapshots"][new] = {"parent": parent, "tables": {**before, **held}, "meta": meta or {}}
            now["refs"][ref] = new

        self._changed(change)
        return new

    def _snapshot(self, ref: str) -> dict | None:
        name, _, back = ref.partition("~")
        now = self.manifest()
        at = now["refs"].get(name, name)
        for _ in range(int(back or 0)):
            at = now["snapshots"].get(at, {}).get("parent")
        return now["snapshots"].get(at)

    def load(self, ref: str) -> dict[str, DataFrame] | None:
        """The tables of a ref or snapshot, or None if there is none."""
        found = self._snapshot(ref)
        return None if found is None else {name: self.spark.read.parquet(*(f"{self.path}/{p}" for p in parts)) for name, parts in found["tables"].items()}

    def meta(self, ref: str) -> dict[str, str]:
        """What was said at the publication of a ref, ``unknown`` where nothing was."""
        found = self._snapshot(ref)
        return UNKNOWN | (found["meta"] if found else {})


def save_graph(store: Store, reverse: DataFrame, ref: str = "graph") -> str:
    """Publish inverted dependencies (name, dependents)."""
    return store.publish(ref, {"reverse_deps": reverse})


def load_graph(store: Store, ref: str = "graph") -> DataFrame:
    """name, dependents; no rows where nothing sound was published."""
    tables = store.load(ref) or {}
    return tables.get("reverse_deps", store.spark.createDataFrame([], "name string, dependents array<string>"))
