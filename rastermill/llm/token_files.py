"""Flat token files: <name>.bin holds unsigned integers, <name>.idx the document ids and 64-bit offsets."""

from __future__ import annotations

import struct
import uuid
import zlib
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, open_fs, order_bounds, partitions, prepare, range_bucket, scratch
from .tokens import Encoder, byte_slices, with_end

#: .idx: this mark, bytes per id, number of documents; then their ids (int64), bits of the ids that are null, and n+1 token offsets
#: within the file (uint64).
MAGIC, HEADER = b"TOKIDX2\0", "<8sQQ"
MANIFEST = "bucket long, path string, n_docs long, n_tokens long"


def _flush(fs, path: str, ids: list, sizes: np.ndarray, width: int) -> None:
    with fs.open_output_stream(f"{path}.idx") as out:
        out.write(struct.pack(HEADER, MAGIC, width, len(ids)))
        out.write(np.array([x or 0 for x in ids], "<i8").tobytes())
        out.write(np.packbits([x is None for x in ids]).tobytes())
        out.write(np.r_[0, np.cumsum(sizes)].astype("<u8").tobytes())


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, vocabulary: int, id_col: str = "doc_id", text_col: str = "text", special_as_text: bool = False) -> DataFrame:
    """Writes the files, in ascending id order from file to file and within each; returns rows MANIFEST (materialised).

    One range shuffle by id.  Each attempt of a task writes under names of its own and only the names in the manifest count, so a
    repeated or half-done attempt does no harm.  Null texts are empty, null ids come first, rows of one id stay next to each other;
    texts of any length are read whole; other columns are ignored; no rows, no files.
    """
    spark = docs.sparkSession
    prepare(spark)
    width = 2 if vocabulary <= 1 << 16 else 4
    n = partitions(spark)
    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    dealt = kept.withColumn("bucket", range_bucket("doc_id", order_bounds(kept, "doc_id", n))).repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket", "doc_id", "text")

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        enc, (fs, path), name, out = Encoder(tokenizer, special_as_text), open_fs(folder), uuid.uuid4().hex, None
        keys, sizes, bucket = [], [], None
        for batch in batches:
            if out is None and batch.num_rows:
                fs.create_dir(path)
                out, bucket = fs.open_output_stream(f"{path}/{name}.bin"), batch.column(2)[0].as_py()
            keys += batch.column(0).to_pylist()
            texts = pc.fill_null(batch.column(1), "")
            for lo, hi in byte_slices(texts):
                ids, size = with_end(*enc(texts.slice(lo, hi - lo)), end_id)
                out.write(ids.astype(f"<u{width}").tobytes())
                sizes.append(size)
        if out is not None:
            out.close()
            size = np.concatenate(sizes)
            _flush(fs, f"{path}/{name}", keys, size, width)
            yield pa.RecordBatch.from_pydict({"bucket": [bucket], "path": [f"{folder}/{name}"], "n_docs": [len(keys)], "n_tokens": [int(size.sum())]}, pa.schema([("bucket", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    return cut_lineage(dealt.mapInArrow(run, MANIFEST))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files.  A file's base is the prefix sum of the manifest (a row per file, so bounded by the number of tasks)."""
    import pyarrow as pa

    spark = manifest.sparkSession
    files = sorted(manifest.collect())
    bases = [0, *accumulate(f.n_tokens for f in files)]
    listed = [(f.path, b) for f, b in zip(files, bases, strict=False)]
    dealt = spark.createDataFrame(listed, "path string, base long").repartition(max(1, len(listed)))

    def run(batches):
        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, path = open_fs(uri)
                with fs.open_input_stream(f"{path}.idx") as f:
                    magic, width, n = struct.unpack(HEADER, f.read(struct.calcsize(HEADER)))
                    if magic != MAGIC:
                        raise ValueError(f"{uri}.idx is not an index")
                    ids, none = np.frombuffer(f.read(8 * n), "<i8"), np.unpackbits(np.frombuffer(f.read(-(-n // 8)), np.uint8), count=n).astype(bool)
                    at = np.frombuffer(f.read(8 * (n + 1)), "<u8").astype(np.int64)
                local = fs.type_name == "local"
                with pa.memory_map(f"{path}.bin") if local else fs.open_input_file(f"{path}.bin") as f:
                    crc = []
                    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                        f.seek(a * width)
                        got = np.frombuffer(f.read_buffer((b - a) * width) if local else f.read((b - a) * width), f"<u{width}")
                        crc.append(zlib.crc32(got.astype("<u4").tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=none), pa.array(base + at[:-1]), pa.array(np.diff(at)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 0, vocabulary: int = 1 << 16, **options) -> DataFrame:
    """Encode, write, read back."""
    folder = scratch(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, folder, tokenizer, end_id, vocabulary, **options))
