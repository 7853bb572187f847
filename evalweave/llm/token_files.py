"""Token-id files: flat unsigned integers plus 64-bit document offsets, read back memory-mapped.

Layout of a data set below one folder: for part p, ``p.ids`` holds the ids of its documents one after
the other (little-endian, 16 bits where every id fits, else 32), ``p.offsets`` the 64-bit start of each document within the part
and one more entry for the end, ``p.docs`` the 64-bit document ids. Parts hold ascending ranges
of doc_id; what comes before a part is a prefix sum over the parts' totals.

Cases: a null text is an empty document (its end id only); an empty table gives no part and no row; repeated doc_ids
keep one entry each, next to one another, ordered by text; a row whose doc_id is null can't be addressed and is refused with an error. Other columns are not read.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalweave.llm.common import list_column, scratch, small_batches, steps

MANIFEST = "part int, n_docs long, n_tokens long, folder string, width int"


def _local(folder: str) -> str:
    """The path that this machine opens. Mapping files into memory needs a mounted shared folder."""
    if folder.startswith("file:"):
        return "/" + folder.removeprefix("file:").lstrip("/")
    if "://" in folder:
        raise ValueError(f"token files need a mounted folder, not {folder}")
    return folder


def _put(path: str, write: Callable) -> None:
    """The file appears whole or not at all; a second attempt of the same task replaces it by the same bytes."""
    with open(temp := f"{path}.{uuid.uuid4().hex}", "wb") as f:
        write(f)
    os.replace(temp, path)


def write_token_files(
    docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", width: int = 16, parts: int | None = None
) -> DataFrame:
    """Encode every text, end it with ``end_id``, write the parts; one row per part comes back (:data:`MANIFEST`).

    The documents are dealt by ranges of doc_id, so that each part is sorted by itself. A part's ids are written step by step: memory holds one step of texts.
    """
    small_batches(docs.sparkSession)
    n = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    doc_id = F.coalesce(F.col(id_col).cast("long"), F.raise_error(F.lit("a document without doc_id has no place in the files")))
    rows = docs.select(doc_id.alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")

    def parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from evalweave.llm.words_bpe import encoder

        part, encode = TaskContext.get().partitionId(), encoder(tokenizer_path).encode
        os.makedirs(base := _local(folder), exist_ok=True)
        ids_of, lengths, kind = [], [], np.dtype(f"<u{width // 8}")
        total = 0
        name = f"{base}/{part}.ids.{uuid.uuid4().hex}"
        with open(name, "wb") as out:
            for batch in batches:
                texts = batch.column("text")
                for first, last in steps(texts):
                    flat, counts = encode(texts.slice(first, last - first).to_pylist())
                    both = np.empty(len(flat) + len(counts), dtype=kind)
                    ends = np.cumsum(counts + 1)
                    put = np.ones(len(both), dtype=bool)
                    put[ends - 1] = False
                    if len(flat) and int(flat.max()) > np.iinfo(kind).max:
                        raise ValueError(f"an id doesn't fit {width} bits")
                    both[put], both[ends - 1] = flat, end_id
                    both.tofile(out)
                    lengths.append(counts + 1)
                    total += len(both)
                ids_of.append(batch.column("doc_id").to_numpy())
        if not lengths:
            os.remove(name)
            return
        os.replace(name, f"{base}/{part}.ids")
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(lengths))]).astype("<i8")
        _put(f"{base}/{part}.offsets", offsets.tofile)
        _put(f"{base}/{part}.docs", np.concatenate(ids_of).astype("<i8").tofile)
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n_docs": [len(offsets) - 1], "n_tokens": [total], "folder": [folder], "width": pa.array([width], pa.int32())})

    return rows.mapInArrow(parts_of, MANIFEST)


def with_bases(manifest: DataFrame) -> DataFrame:
    """Ids before each part: a prefix sum over one row per part."""
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def read_token_files(manifest: DataFrame, with_ids: bool = True, chunk_tokens: int = 4 << 20) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, the ids of each document, from the mapped files.

    ``manifest`` has a row per part with its base. Each part is a task of its own; a mapping holds no more than the pages in use.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at = f"{_local(row['folder'])}/{row['part']}"
                ids = np.memmap(f"{at}.ids", dtype=f"<u{row['width'] // 8}", mode="r")
                offsets = np.memmap(f"{at}.offsets", dtype="<i8", mode="r")
                docs = np.memmap(f"{at}.docs", dtype="<i8", mode="r")
                first = 0
                while first < len(docs):
                    last = int(np.searchsorted(offsets, offsets[first] + chunk_tokens, side="right")) - 1
                    last = min(max(last, first + 1), len(docs))
                    low = int(offsets[first])
                    wide = ids[low : int(offsets[last])].astype("<u4")
                    cut = np.asarray(offsets[first : last + 1]) - low
                    view = memoryview(wide).cast("B")
                    crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                    out = {"doc_id": np.asarray(docs[first:last]), "start": row["base"] + low + cut[:-1], "n_tokens": np.diff(cut), "ids_crc32": np.array(crc, dtype=np.int64)}
                    if with_ids:
                        out["ids"] = list_column(wide.astype(np.int64), np.diff(cut), pa.int64())
                    yield pa.RecordBatch.from_pydict(out)
                    first = last

    n = max(1, manifest.count())
    return manifest.repartition(n, "part").mapInArrow(documents, schema)


def token_files(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Write the files of ``docs`` into the shared folder and read them back, a digest per document.

    The manifest, a row a part, is one file: for a file a part, executors would start three ``chmod`` processes each, as Hadoop's local file system does without its native library.
    """
    folder = scratch(spark, "token-files")
    manifest = write_token_files(docs, folder, tokenizer_path, end_id)
    manifest.repartition(1).write.parquet(f"{folder}-manifest")
    return read_token_files(with_bases(spark.read.schema(MANIFEST).parquet(f"{folder}-manifest")), with_ids=False)


