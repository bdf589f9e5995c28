"""Token ids as flat unsigned integer files with 64-bit document offsets, to be memory-mapped.

Each task encodes the documents of its partition (each distinct piece once, by the tiktoken library) and writes their tokens one after another to its own file of
unsigned little-endian integers (16 bits where the vocabulary allows it, else 32). The number of tokens in each file
is known then; prefix sums over files in partition order give each partition's base, and the offsets of its documents
in the whole are written as 64-bit integers beside the tokens: n + 1 of them, so that document i of a file is
[offsets[i] - base, offsets[i + 1] - base). Tokens are never moved again. A file's name is unique to the attempt that
wrote it, and only files named by rows that were committed are read, so that a task that ran twice does no harm. Before
they are written, tokens are decoded and compared with the text; a difference ends the job.

Defined results: a null or empty text has no tokens, yet a row and an offset; a text of any length is written whole;
repeated rows are written each; an empty table gives no file and no row; a null doc_id stays null; columns other
than doc_id and text are not touched.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrille.llm import bpe, files
from quadrille.llm import text as T
from quadrille.shared import fresh_path, local_path

ROWS = "doc_id bigint, part bigint, file string, doc_in_part bigint, start_in_part bigint, n_tokens bigint"


def write(docs: DataFrame, folder: str | None = None, path: str = bpe.VOCABULARY) -> DataFrame:
    """Write the tokens of docs below folder; one row for each document.

    doc_id, part, file, doc_in_part, token_start (in the whole), n_tokens, dtype. The folder holds *.tokens, *.offsets
    and the table parts (part, file, docs, tokens, base).
    """
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, name, out = TaskContext.get().partitionId(), "", None
        c, docs_done, tokens_done = bpe.codec(path, native=True), 0, 0
        kind = np.dtype("<u2" if c.size <= 1 << 16 else "<u4")
        try:
            for b in batches:
                if not b.num_rows:
                    continue
                if out is None:
                    system, place = files.place(folder)
                    system.create_dir(place, recursive=True)
                    name = f"part-{part:06d}-{uuid.uuid4().hex}"
                    out = system.open_output_stream(f"{place}/{name}.tokens")
                data, offs = T.buffers(b.column("text"))
                for i, j in T.chunks(offs, bpe.CHUNK):
                    d, o = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                    tokens, to = c.encode(d, o)
                    if not c.gives_back(tokens, to, d, o).all():
                        raise ValueError("tokens don't give the text back")
                    out.write(tokens.astype(kind).tobytes())
                    m = j - i
                    yield pa.RecordBatch.from_arrays([b.column("doc_id")[i:j], pa.array(np.full(m, part)), pa.array([name] * m, pa.string()), pa.array(np.arange(docs_done, docs_done + m)), pa.array(to[:-1] + tokens_done), pa.array(np.diff(to))], ["doc_id", "part", "file", "doc_in_part", "start_in_part", "n_tokens"])
                    docs_done, tokens_done = docs_done + m, tokens_done + len(tokens)
        finally:
            if out is not None:
                out.close()

    rows_at = f"{folder}/documents"
    T.keyed(docs, {"doc_id": "bigint", "text": "string"}).mapInArrow(run, ROWS).write.mode("overwrite").parquet(rows_at)
    rows = spark.read.schema(ROWS).parquet(rows_at)
    # One row for each file: a sum over files in one task is small beside the files.
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("part", "file").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens")).withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    parts.write.mode("overwrite").parquet(f"{folder}/parts")
    parts = spark.read.parquet(f"{folder}/parts")
    based = rows.join(parts.select("part", "file", "base"), ["part", "file"]).withColumn("token_start", F.col("start_in_part") + F.col("base"))

    def offsets(pdf):
        pdf = pdf.sort_values("doc_in_part")
        a = np.append(pdf.token_start.to_numpy(np.int64), pdf.token_start.iloc[-1] + pdf.n_tokens.iloc[-1]).astype("<i8")
        system, place = files.place(folder)
        with system.open_output_stream(f"{place}/{pdf.file.iloc[0]}.offsets") as out:
            out.write(a.tobytes())
        return pdf[["file"]].head(1).assign(offsets=len(a))

    based.select("file", "doc_in_part", "token_start", "n_tokens").groupBy("file").applyInPandas(offsets, "file string, offsets bigint").write.mode("overwrite").parquet(f"{folder}/offset_files")
    return based.select("doc_id", "part", "file", "doc_in_part", "token_start", "n_tokens").withColumn("folder", F.lit(folder))


class TokenReader:
    """Documents of a token folder, memory-mapped; the folder must be mounted where this runs."""

    def __init__(self, spark: SparkSession, folder: str, path: str = bpe.VOCABULARY):
        self.folder = local_path(folder)
        self.kind = np.dtype("<u2" if bpe.codec(path).size <= 1 << 16 else "<u4")
        self.parts = spark.read.parquet(f"{folder}/parts").orderBy("base", "file").toPandas()

    def document(self, file: str, doc_in_part: int) -> np.ndarray:
        """The tokens of one document, a view of the mapped file."""
        base = int(self.parts.base[self.parts.file == file].iloc[0])
        offs = np.memmap(f"{self.folder}/{file}.offsets", "<i8", "r")
        a, b = int(offs[doc_in_part]) - base, int(offs[doc_in_part + 1]) - base
        if a == b:
            return np.zeros(0, self.kind)
        return np.memmap(f"{self.folder}/{file}.tokens", self.kind, "r")[a:b]

    def span(self, start: int, stop: int) -> np.ndarray:
        """Tokens [start, stop) of the whole, across files."""
        out = []
        for r in self.parts.itertuples():
            a, b = max(start, r.base) - r.base, min(stop, r.base + r.tokens) - r.base
            if a < b:
                out.append(np.memmap(f"{self.folder}/{r.file}.tokens", self.kind, "r")[a:b])
        return np.concatenate(out) if out else np.zeros(0, self.kind)


def op3_token_files(spark, sf_dir: str) -> DataFrame:
    return write(spark.read.parquet(f"{sf_dir}/documents.parquet"))
