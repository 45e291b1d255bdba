"""Framed logs whose dumps may be larger than a task: cut at job headers, not at blocks.

The text source cuts at ``- job_id:`` lines and splits files anywhere, so the jobs of one dump are parsed in many tasks.
Each piece then needs the header of its block. Within a split it is carried along in the order of the text. A first pass
gives one row per split: the header in force at its end, and which blocks have their end line; ordered by file offset
these rows tell what a split begins in, and whether a block that goes beyond it is ever ended. A block without an end
line is left out whole, as when blocks are read one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobtally.session import importable, written
from jobtally.sources.raw_log import END_LINE, HEADER_START, LINE_SEP, split_frames

JOB_SEP = "\n- job_id:"
BATCH = 2000  # pieces

_PIECE = pa.schema([("file", pa.string()), ("split", pa.int64()), ("own", pa.int64()), ("header", pa.string()), ("text", pa.string())])
PIECE = "file string, split long, own long, header string, text string"

_SPLIT = pa.schema(
    [
        ("file", pa.string()), ("split", pa.int64()), ("head_ended", pa.bool_()), ("own", pa.int64()), ("header", pa.string()),
        ("tail_ended", pa.bool_()), ("cut", pa.list_(pa.int64())),
    ]
)
SPLIT = "file string, split long, head_ended boolean, own long, header string, tail_ended boolean, cut array<long>"


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(file, split, number in it, header or null, text, ended) of each part of each record, in the order of the text.

    A part with a header opens a block, any other goes on with the block before.
    """
    at, number = None, 0
    for batch in batches:
        for file, split, value in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            if (file, split) != at:
                at, number = (file, split), 0
            if number or split:  # the separator was cut off
                value = JOB_SEP + value
            elif value.startswith(HEADER_START):
                value = "\n" + value
            for n, part in enumerate(value.split(LINE_SEP)):
                header = None
                if n:
                    header, _, part = part.partition("\n")
                    part = "\n" + part
                text, end, _ = part.partition("\n" + END_LINE)
                yield file, split, number, header, text, bool(end)
                number += 1


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts with the header and number of their block; ``own`` is null for the block the split begins in."""
    own, header, open_, out = None, None, True, []
    for file, split, number, opened, text, ended in _parts(batches):
        if number == 0:
            own, header, open_ = None, None, True
        if opened is not None:
            own, header, open_ = number, opened, True
        if open_:
            out.append((file, split, own, header, text))
        open_ = open_ and not ended
        if len(out) == BATCH:
            yield _batch(out, _PIECE)
            out = []
    if out:
        yield _batch(out, _PIECE)


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per split. ``own`` numbers its last block, ``cut`` lists those before it that have no end line."""
    row: list | None = None
    for file, split, number, opened, _, ended in _parts(batches):
        if number == 0:
            if row:
                yield _batch([row], _SPLIT)
            row = [file, split, False, None, None, False, []]
        if opened is not None:
            if row[3] is not None and not row[5]:
                row[6].append(row[3])
            row[3:6] = number, opened, False
        if ended and row[3] is None:
            row[2] = True
        elif ended:
            row[5] = True
    if row:
        yield _batch([row], _SPLIT)


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*rows), schema, strict=True)], schema=schema)


def _edges(splits: DataFrame) -> DataFrame:
    """Per split: the header it begins in if that block is open, and whether it and the last block of the split are ended.

    A window group has the splits of one file, a row each.
    """
    opens = F.col("header").isNotNull()
    state = F.when(opens, F.struct("header", (~F.col("tail_ended")).alias("open"))).when(
        F.col("head_ended"), F.struct("header", F.lit(False).alias("open"))
    )
    next_end = F.when(F.col("head_ended"), True).when(opens, False)
    in_file = Window.partitionBy("file").orderBy("split")
    before = F.last(state, ignorenulls=True).over(in_file.rowsBetween(Window.unboundedPreceding, -1))
    later = F.first(next_end, ignorenulls=True).over(in_file.rowsBetween(1, Window.unboundedFollowing))
    ended_later = F.coalesce(later, F.lit(False))
    return splits.select(
        "file",
        "split",
        F.when(before["open"], before["header"]).alias("carried"),
        (F.col("head_ended") | (~opens & ended_later)).alias("head_kept"),
        F.col("own").alias("last_own"),
        (F.col("tail_ended") | ended_later).alias("tail_kept"),
        "cut",
    )


def read_large_logs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Blocks of framed logs as ``read_raw_log`` gives them, but in pieces: a row for the head of each block and one per job.

    ``parse_job_stats`` makes the same of them. The first pass over the text runs at once and stores its row per split
    in the shared folder; knowing the size of that table, the planner broadcasts it if it is small, and then the second
    pass moves no text.
    """
    importable(spark)
    text = spark.read.option("lineSep", JOB_SEP).text(path)
    records = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")
    pieces = records.mapInArrow(_pieces, PIECE)
    edges = written(_edges(records.mapInArrow(_splits, SPLIT)), "splits")
    kept = (
        F.when(F.col("own").isNull(), F.col("carried").isNotNull() & F.col("head_kept"))
        .when(F.col("own") == F.col("last_own"), F.col("tail_kept"))
        .otherwise(~F.array_contains("cut", F.col("own")))
    )
    header = F.coalesce("header", "carried")
    framed = F.concat(F.lit(HEADER_START), header, "text", F.lit("\n" + END_LINE))
    return split_frames(pieces.join(edges, ["file", "split"]).where(kept).select(framed.alias("value")))
