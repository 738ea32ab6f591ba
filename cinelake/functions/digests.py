"""Digests of values that are never one value: ordered parts folded row by row."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame


def fold_md5(parts: DataFrame, keys: Sequence[str], order: Sequence[str], column: str = "bytes") -> DataFrame:
    """(keys, n_parts, size, hash): the MD5 of the parts of each key, joined in order.

    Parts are dealt by key and sorted inside the partition (Spark spills what does not fit); the digest's state goes from row to row, so a key of any size takes constant memory. A NULL part has no
    bytes. One key is one task: the fold is sequential by nature.
    """
    types = {f.name: f.dataType.simpleString() for f in parts.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, count, size, done, schema = None, None, 0, 0, [], None

        def rows() -> pa.RecordBatch:
            names = [*keys, "n_parts", "size", "hash"]
            kinds = [*(schema.field(k).type for k in keys), pa.int64(), pa.int64(), pa.string()]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names=names)
            done.clear()
            return out

        for batch in batches:
            schema = batch.schema
            for key, value in zip(zip(*[batch.column(k).to_pylist() for k in keys]), batch.column(column)):
                if state is None or key != last:
                    if state is not None:
                        done.append((*last, count, size, state.hexdigest()))
                    last, state, count, size = key, hashlib.md5(usedforsecurity=False), 0, 0
                data = value.as_buffer() if value.is_valid else b""
                state.update(data)
                count, size = count + 1, size + len(data)
            if len(done) >= 1 << 13:
                yield rows()
        if state is not None:
            done.append((*last, count, size, state.hexdigest()))
            yield rows()

    ddl = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", n_parts bigint, size bigint, hash string"
    return parts.select(*dict.fromkeys([*keys, *order]), column).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, ddl)
