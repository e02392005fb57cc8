"""Packing along a space-filling curve: neighbouring documents fill sequences of equal length.

Each document is tokenized once; its ids, counted by hash bucket, form a vector that a fixed random matrix projects to a few
dimensions. The Hilbert index of that point (Skilling, "Programming the Hilbert curve", 2004) is the sort key: documents near on
the curve are alike. Rows are range-partitioned and sorted by the key and laid end to end; every full stretch of ``length`` ids is
a sequence, so only the last ids of a range can fall short, and those are cut into sequences of falling powers of two.
The ids are written once to a shared table and shuffled once. Copies share a key; ranges may cut between them.

Edges: null text is empty and holds only the end id; texts of any length are cut across sequences; null or repeated ids are
separate documents; an empty table has no pieces; only the key and text columns are read, so other names cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from cardwatch.llm.common import ByteBpe, table
from cardwatch.runtime import stored

LENGTH = 1024
END_ID = 0
#: counted hash buckets, projected dimensions, bits of each on the curve
BUCKETS, DIMENSIONS, BITS = 256, 4, 15
#: ids aimed at in one range
IDS_PER_RANGE = 4_000_000
#: most ids of one stored row; longer documents are rows of several blocks, so ranges of equal rows hold like numbers of ids
BLOCK = 4096
#: characters of text encoded at once
CHUNK = 4_000_000
ROW = "doc_id string, curve long, tie long, start long, doc_tokens long, n long, ids binary"
PACKED = ["doc_id", "start", "doc_tokens", "ids"]
PIECES = "doc_id string, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def hilbert(points, bits: int):
    """Index along the Hilbert curve of unsigned integer points (n, d), each coordinate of ``bits`` bits."""
    import numpy as np

    x = points.astype(np.int64).copy()
    dims = x.shape[1]
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for i in range(dims):
            set_ = (x[:, i] & bit) != 0
            swap = np.where(set_, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(set_, low, swap)
            if i:
                x[:, i] ^= swap
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(len(x), np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[:, -1] & (1 << level), (1 << level) - 1, 0)
    x ^= turn[:, None]
    key = np.zeros(len(x), np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[:, i] >> level) & 1)
    return key


def chunks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about ``CHUNK`` characters, so that a batch of long ones stays in bounds."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text) + 64
        if size > CHUNK:
            yield start, texts[start:i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]


def encoder(tokenizer_json: str, seed: int):
    """mapInPandas function: (doc_id, text) to blocks (``ROW``); a document's last block ends with ``END_ID``."""

    def encode(batches):
        import numpy as np
        import pandas as pd

        bpe = ByteBpe(tokenizer_json, added=True)
        random = np.random.default_rng(seed)
        bucket = random.integers(0, BUCKETS, bpe.size)
        matrix = random.standard_normal((BUCKETS, DIMENSIONS))
        top, width = (1 << BITS) - 1, bpe.kind.itemsize
        end, count, names = END_ID.to_bytes(width, "little"), 0, [c.split()[0] for c in ROW.split(", ")]
        for batch in batches:
            texts = batch["text"].fillna("").tolist()
            for at, part in chunks(texts):
                ids = bpe.encode(part)
                counts = np.array([np.bincount(bucket[np.frombuffer(x, bpe.kind)], minlength=BUCKETS) for x in ids])
                vector = np.sqrt(counts)
                vector /= np.maximum(np.sqrt((vector ** 2).sum(axis=1, keepdims=True)), 1e-12)
                points = np.clip((vector @ matrix + 4) / 8, 0, 1) * top
                curve = hilbert(points.astype(np.int64), BITS)
                rows = []
                for doc, key, own in zip(batch["doc_id"].iloc[at:at + len(part)], curve.tolist(), ids, strict=True):
                    count, own = count + 1, own + end
                    tie, total = zlib.crc32(own) << 31 | count & 0x7FFFFFFF, len(own) // width
                    for start in range(0, total, BLOCK):
                        block = own[start * width:(start + BLOCK) * width]
                        rows.append((doc, key, tie, start, total, len(block) // width, block))
                yield pd.DataFrame(rows, columns=names)

    return encode


def packer(length: int, width: int):
    """mapInPandas function over one sorted range: lay documents end to end, cut every ``length`` ids."""

    def cut(pieces, sequence, size):
        """Take ``size`` ids off the front of ``pieces``: rows of one sequence, and what is left."""
        rows, offset = [], 0
        while offset < size:
            doc, start, total, ids = pieces[0]
            n = min(len(ids), size - offset)
            rows.append((doc, start, n, total, sequence, offset, ids[:n].tobytes()))
            if n < len(ids):
                pieces[0] = (doc, start + n, total, ids[n:])
            else:
                pieces.popleft()
            offset += n
        return rows

    def pack(batches):
        from collections import deque

        import numpy as np
        import pandas as pd
        from pyspark import TaskContext

        kind = np.dtype(f"<u{width}")
        sequence, waiting, open_ids = TaskContext.get().partitionId() << 33, deque(), 0
        names = [c.split()[0] for c in PIECES.split(", ")]
        for batch in batches:
            rows = []
            for doc, start, total, ids in zip(*(batch[c].tolist() for c in PACKED), strict=True):
                waiting.append((doc, start, total, np.frombuffer(ids, kind).astype("<u4")))
                open_ids += len(waiting[-1][3])
                while open_ids >= length:
                    rows += cut(waiting, sequence, length)
                    sequence, open_ids = sequence + 1, open_ids - length
            if rows:
                yield pd.DataFrame(rows, columns=names)
        rows = []
        while open_ids:
            size = 1 << (open_ids.bit_length() - 1)
            rows += cut(waiting, sequence, size)
            sequence, open_ids = sequence + 1, open_ids - size
        if rows:
            yield pd.DataFrame(rows, columns=names)

    return pack


def tokenizer_file(path: str | None = None) -> str:
    """The tokenizer's JSON, read on the driver (a file of fixed size) and sent with the tasks."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as file:
        return file.read()


def pack(docs: DataFrame, *, tokenizer: str | None = None, length: int = LENGTH, seed: int = 42, key: str = "doc_id",
         text: str = "text") -> DataFrame:
    """Pieces (doc_id, start, length, doc_tokens, sequence_id, offset, ids as little-endian unsigned 32-bit)."""
    source = tokenizer_file(tokenizer)
    width = ByteBpe(source, added=True).kind.itemsize
    rows = docs.select(F.col(key).cast("string").alias("doc_id"), F.col(text).alias("text"))  # exact in pandas, nulls too
    blocks = stored(rows.mapInPandas(encoder(source, seed), ROW), "pack-ids", compression="zstd")
    total = blocks.agg(F.sum("n")).first()[0] or 0
    order = ["curve", "doc_id", "tie", "start"]
    ranges = blocks.repartitionByRange(int(-(-total // IDS_PER_RANGE)) or 1, *order).sortWithinPartitions(*order)
    pieces = ranges.select(PACKED).mapInPandas(packer(length, width), PIECES)
    return pieces.withColumn("doc_id", F.col("doc_id").cast(docs.schema[key].dataType))


def op3_pack(spark, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
