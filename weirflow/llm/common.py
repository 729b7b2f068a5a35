"""What several operators share: reliable checkpoints, words, hashes."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.operators.state import noted

#: ASCII white space: what separates words unless an operator says otherwise.
SPACE = " \t\n\x0b\f\r"


def reliable(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the folder all executors share, so a lost executor costs nothing but a reread.
    Inside ``operators.state.passing`` or ``settled`` it is removed at their end."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if shared is None and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return noted(df.checkpoint())


def text_of(column: str | Column) -> Column:
    """The text, a null as the empty one."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores as it takes to be no column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, however often the body's lambdas use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batches in runs of rows whose ``column`` (texts) holds about ``most`` bytes, a longer text alone: what a worker holds
    at once does not grow with Spark's batches."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype("int64")
        run = (sizes.cumsum() - sizes) // most
        bounds = [0, *(i + 1 for i in range(len(run) - 1) if run[i + 1] != run[i]), len(run)]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b > a:
                yield batch.slice(a, b - a)


_held: dict = {}


def held(name: str, key, make: Callable):
    """A worker's table ``name`` for ``key``. Workers outlive a stage, so the table of another operator, or of another key,
    goes before a new one is made."""
    if _held.get("of") != (name, key):
        _held.clear()
        _held.update({"of": (name, key), "table": make()})
    return _held["table"]
