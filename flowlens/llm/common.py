"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.session import materialize  # noqa: F401  (re-exported)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(df: DataFrame, col: str) -> int:
    """Total UTF-8 bytes of a text column (one narrow aggregation)."""
    return int(df.agg(F.sum(F.octet_length(F.col(col)))).first()[0] or 0)


# ---- documents dealt into blocks

PACK_BYTES = 24 << 20          # text that a task gathers before it hands packs on


def free_name(taken: list[str], base: str) -> str:
    """``base``, with underscores behind it until no column of ``taken`` has that name (in any case)."""
    low = {c.lower() for c in taken}
    while base.lower() in low:
        base += "_"
    return base


def count_blocks(src: DataFrame, text_col: str, block_bytes: int) -> int:
    """Blocks of about ``block_bytes`` of text; small inputs still get one for each shuffle partition, down
    to a MB of text."""
    size = text_bytes(src, text_col)
    return max(1, -(-size // block_bytes), min(shuffle_parts(src.sparkSession), size >> 20))


def deal_blocks(src: DataFrame, text_col: str, keys: list[str], block_bytes: int,
                pack_bytes: int = PACK_BYTES) -> tuple[DataFrame, int]:
    """``src`` dealt into blocks of about ``block_bytes`` of text by a hash of ``keys`` and the text's
    length (so many rows of one key, or of none, spread): (block int, rows binary), in as many
    partitions as returned. ``rows`` are record batches in Arrow's stream format, Zstandard-compressed
    (``open_rows``); a block has several such rows. Both uses of one result must read all its columns,
    then Spark deals the texts once and reuses the exchange."""
    n_blocks = count_blocks(src, text_col, block_bytes)
    block = F.pmod(F.xxhash64(*keys, F.coalesce(F.octet_length(text_col), F.lit(0))), F.lit(n_blocks)).cast("int")
    return pack_blocks(src, block, n_blocks, pack_bytes)


def pack_blocks(src: DataFrame, block, n_blocks: int, pack_bytes: int = PACK_BYTES) -> tuple[DataFrame, int]:
    """``deal_blocks`` with the block of a row given, an int column from 0 to ``n_blocks`` - 1."""
    parts = max(shuffle_parts(src.sparkSession), -(-n_blocks // 8))
    names = src.columns
    plain = [f"c{i}" for i in range(len(names))]        # Arrow functions can't take names with dots
    packed = pa.schema([("block", pa.int32()), ("rows", pa.binary())])

    def pack(it):
        held, size = [], 0

        def flush():
            table = pa.Table.from_batches(held)
            blocks = table.column("block").to_numpy()
            order = np.argsort(blocks, kind="stable")
            table, blocks = table.select(plain).rename_columns(names).take(pa.array(order)), blocks[order]
            cuts = np.append(np.flatnonzero(np.concatenate([[True], blocks[1:] != blocks[:-1]])), len(blocks)).tolist()
            options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))
            for a, b in zip(cuts[:-1], cuts[1:]):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, table.schema, options=options) as out:
                    out.write_table(table.slice(a, b - a).combine_chunks())
                yield pa.RecordBatch.from_arrays([pa.array([int(blocks[a])], pa.int32()),
                                                  pa.array([sink.getvalue().to_pybytes()], pa.binary())], schema=packed)

        for b in it:
            if b.num_rows:
                held.append(b)
                size += b.nbytes
            if size >= pack_bytes:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    source = src.select(*[F.col(f"`{c}`").alias(p) for c, p in zip(names, plain)], block.alias("block"))
    dealt = source.mapInArrow(pack, "block int, rows binary").repartition(parts, "block")
    return dealt, parts


def open_rows(table: pa.Table) -> pa.Table:
    """The documents of one block."""
    return pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in table.column("rows")])
