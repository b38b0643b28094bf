"""Products that are built again only when something they are made of has changed.

What a product is made of is not listed but seen: a product is computed from a recorder
that hands out its inputs and notes their names, so the ancestors of any product follow
from its code. Stored products are snapshot tables; each manifest keeps the content
versions of the inputs it was made of, and a digest of its own rows, taken while they were
written. A build compares versions from the sources upwards. Where an input was written
again with the same content, nothing that depends on it alone is.
"""

from __future__ import annotations

import hashlib
import inspect
from collections.abc import Iterable
from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwright.plans.products import BY_DAY, Products
from ledgerwright.sources.snapshots import SnapshotTable
from ledgerwright.sources.sinks import PARTITION

SOURCE = "raw"
# Products that are projections of another one; what is made of them is made of that.
VIEWS = {"staged", "enriched", "ml_dataset", "labelled_rows", "modeling_rows"}


def _digest(df: DataFrame):
    """An aggregate that depends on the rows alone, not on their order."""
    columns = [F.col(c) for c in sorted(df.columns)]
    # A hash skips NULLs, so which columns are NULL is hashed too.
    shape = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in columns])
    return F.sum(F.xxhash64(shape, *columns).cast("decimal(38,0)"))


class _Recorder:
    """Stands for the products while one of them is computed."""

    def __init__(self, build: TrackedBuild):
        self._build = build
        self.made_of: dict[str, str] = {}

    def __getattr__(self, name: str):
        if name != SOURCE and not isinstance(Products.__dict__.get(name), cached_property):
            return getattr(self._build.products, name)
        df, made_of = self._build.provided(name)
        self.made_of |= made_of
        return df


class TrackedBuild:
    """A build of products below `folder`; `written` names those written by it, in order."""

    def __init__(self, products: Products, folder: str):
        self.products = products
        self.folder = folder
        self.written: list[str] = []
        self._provided: dict[str, tuple[DataFrame, dict[str, str]]] = {}

    def provided(self, name: str) -> tuple[DataFrame, dict[str, str]]:
        """A product, up to date, and the version of what stands for it."""
        if name not in self._provided:
            if name == SOURCE:
                df = self.products.raw
                row = df.agg(F.count(F.lit(1)), _digest(df)).first()
                self._provided[name] = df, {name: f"{row[0]}:{row[1]}"}
            elif name in VIEWS:
                recorder = _Recorder(self)
                df = Products.__dict__[name].func(recorder)
                self._provided[name] = df, recorder.made_of
            else:
                self._provided[name] = self._stored(name)
        return self._provided[name]

    def _stored(self, name: str) -> tuple[DataFrame, dict[str, str]]:
        compute = Products.__dict__[name].func
        code = hashlib.sha256(inspect.getsource(compute).encode()).hexdigest()
        table = SnapshotTable(self.products.raw.sparkSession, f"{self.folder}/{name}")
        made = table.manifest()
        if made is None or made.notes["code"] != code or not self._current(made.notes["made_of"]):
            recorder = _Recorder(self)
            df = compute(recorder)
            notes = {"code": code, "made_of": recorder.made_of}
            made = table.write(
                df, PARTITION if name in BY_DAY else None, metrics={"digest": _digest(df)}, notes=notes
            )
            self.written.append(name)
        return table.read(), {name: f"{made.written['rows']}:{made.written['digest']}"}

    def _current(self, made_of: dict[str, str]) -> bool:
        return all(self.provided(name)[1].get(name) == version for name, version in made_of.items())

    def build(self, names: Iterable[str]) -> DataFrame:
        """Bring products and all they are made of up to date; `product, row_count`."""
        spark = self.products.raw.sparkSession
        rows = []
        for name in names:
            _, made_of = self.provided(name)
            rows.append((name, int(made_of[name].split(":")[0])))
        return spark.createDataFrame(rows, "product string, row_count bigint")


def ancestors(products: Products, name: str) -> set[str]:
    """All products, and the source, that a product is computed from."""
    found: set[str] = set()

    class Walk:
        def __getattr__(self, inner: str):
            if inner == SOURCE or isinstance(Products.__dict__.get(inner), cached_property):
                if inner not in found:
                    found.add(inner)
                    if inner != SOURCE:
                        Products.__dict__[inner].func(self)
            return getattr(products, inner)

    Products.__dict__[name].func(Walk())
    return found


def group_ancestors(products: Products, names: Iterable[str]) -> set[str]:
    """The products of a group and their ancestors."""
    return reduce(set.union, [{n} | ancestors(products, n) for n in names], set())
