"""Files read by the tasks in blocks: none is held whole, whatever its size.

Tasks open a file through Arrow's file systems, by the scheme of its path.  A file that goes away meanwhile is an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

BLOCK = 1 << 20
#: Rows that a parsed file hands on together.
ROWS = 1 << 14


def files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(path, length) of the files at a path; none is opened.  Spark passes over files without a byte."""
    lookup = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return lookup.load(path).select("path", "length")


def _stream(path: str) -> pa.NativeFile:
    import pyarrow.fs
    from urllib.parse import quote

    scheme, colon, rest = path.partition(":")
    if not colon or scheme == "file":
        return pyarrow.fs.LocalFileSystem().open_input_stream("/" + (rest or scheme).lstrip("/"))
    uri = f"{'s3' if scheme in ('s3a', 's3n') else scheme}:{quote(rest, safe='/:@')}"
    system, place = pyarrow.fs.FileSystem.from_uri(uri)
    return system.open_input_stream(place)


def _each(listed: DataFrame, name: str, kind: str, of: Callable[[Callable], object]) -> DataFrame:
    """``listed`` with a column that ``of`` computes from a function that opens the file of ``path``."""
    at = listed.columns.index("path")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [of(lambda p=p: _stream(p)) for p in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.string() if kind == "string" else pa.binary())], [*batch.schema.names, name])

    return listed.mapInArrow(kernel, StructType([*listed.schema.fields, StructField(name, StringType() if kind == "string" else BinaryType())]))


def heads(listed: DataFrame, size: int) -> DataFrame:
    """Files(path, ...) with ``head``, their first ``size`` bytes."""

    def first(opened: Callable) -> bytes:
        with opened() as source:
            return source.read(size)

    return _each(listed, "head", "binary", first)


def hashed(listed: DataFrame, block: int = BLOCK) -> DataFrame:
    """Files(path, ...) with ``sha256`` of their content, in lower-case hexadecimal digits."""

    def digest(opened: Callable) -> str:
        import hashlib

        total = hashlib.sha256()
        with opened() as source:
            while data := source.read(block):
                total.update(data)
        return total.hexdigest()

    return _each(listed, "sha256", "string", digest)


def parsed(listed: DataFrame, rows_of: Callable[[Iterator[str]], Iterator[tuple]], schema: str) -> DataFrame:
    """(id, ...) of text files(path, ...): the rows that ``rows_of`` makes of each file's lines, read one after the other.

    The id is the file's name without its suffix; ``schema`` lists the columns after it.  A text is UTF-8, or UTF-16 if it begins
    with that mark.
    """
    at = listed.columns.index("path")
    out = StructType([StructField("id", StringType()), *StructType.fromDDL(schema).fields])
    arrow = to_arrow_schema(out)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        def lines(path: str) -> Iterator[str]:
            with _stream(path) as source:
                wide = source.read(2) in (b"\xff\xfe", b"\xfe\xff")
            with _stream(path) as source, io.TextIOWrapper(io.BufferedReader(source, BLOCK), "utf-16" if wide else "utf-8-sig", "replace") as text:
                yield from text

        for batch in batches:
            for path in batch.column(at).to_pylist():
                name = path.rsplit("/", 1)[-1]
                stem = name.rpartition(".")[0] if "." in name else name
                rows = iter(rows_of(lines(path)))
                while some := list(islice(rows, ROWS)):
                    columns = [[stem] * len(some), *zip(*some, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return listed.mapInArrow(kernel, out)
