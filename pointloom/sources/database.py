"""Named collections below one folder."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

from pointloom.config import Distance
from pointloom.errors import ClosedResourceError
from pointloom.sources.collection import Collection, _Files

NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9_-]{0,127}")


class Database:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.closed = spark, f"{path}/collections", False
        self._open: dict[str, Collection] = {}
        files = _Files(spark, self.path)
        files.fs().mkdirs(files.path())

    open = classmethod(lambda cls, spark, path: cls(spark, path))

    def _at(self, name: str) -> str:
        if self.closed:
            raise ClosedResourceError(self.path)
        if not isinstance(name, str) or not NAME.fullmatch(name):
            raise ValueError(f"not a collection's name: {name!r}")
        return f"{self.path}/{name}"

    def names(self) -> list[str]:
        """Of whole collections; folders that a crash left are not among them."""
        self._at("x")
        files = _Files(self.spark, self.path)
        found = [s.getPath().getName() for s in files.fs().listStatus(files.path())]
        return sorted(n for n in found if NAME.fullmatch(n) and files.exists(f"{n}/collection.json"))

    def create_collection(self, name: str, *, dimension: int, distance: Distance, **more) -> Collection:
        return self._opened(name, Collection.create(self.spark, self._at(name), dimension=dimension, distance=distance, **more))

    def _opened(self, name: str, c: Collection) -> Collection:
        self._open[name] = c
        return c

    def collection(self, name: str) -> Collection:
        """The open collection of that name: the same object each time, until it is closed, dropped or replaced."""
        path = self._at(name)
        if name in self._open and not self._open[name].closed and self._open[name].files.exists("collection.json"):
            return self._open[name]
        return self._opened(name, Collection.open(self.spark, path))

    def _forget(self, name: str) -> None:
        if name in self._open:
            self._open.pop(name).close()

    def drop_collection(self, name: str) -> None:
        self.collection(name).drop()
        self._forget(name)

    def restore_collection(self, snapshot: str, name: str, *, replace: bool = False) -> Collection:
        """The snapshot is checked before a collection of that name, with replace=True, goes."""
        path = self._at(name)
        if not replace:
            return self._opened(name, Collection.restore(self.spark, snapshot, path))
        beside = Collection.restore(self.spark, snapshot, f"{self.path}/.{name}-restored")
        files, old = _Files(self.spark, beside.path), _Files(self.spark, f"{self.path}/.{name}-replaced")
        there = _Files(self.spark, path)
        old.fs().delete(old.path(), True)
        if there.exists():  # it steps aside, and goes once the other has its place
            there.fs().rename(there.path(), old.path())
        files.fs().rename(files.path(), there.path())
        old.fs().delete(old.path(), True)
        self._forget(name)
        return self.collection(name)

    def close(self) -> None:
        """Closes the collections that were opened here as well."""
        for name in list(self._open):
            self._forget(name)
        self.closed = True

    def __enter__(self) -> Database:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()
