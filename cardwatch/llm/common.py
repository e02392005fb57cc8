"""What the operators of this folder share: words, tokenizer ids, document keys, reading tables."""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: runs of anything but ASCII white space; the same in Spark, Python's re and RE2
WORD = r"[^\x20\x09-\x0D]+"
#: entries a worker's word cache may hold before it starts anew
CACHE_ENTRIES = 600_000
#: white space other than the plain space
OTHER_SPACE = [chr(c) for c in range(0x3001) if chr(c).isspace() and c != 0x20]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | None) -> list[bytes]:
    """``WORD`` matches of a text as UTF-8: bytes.split cuts at exactly the six ASCII white spaces."""
    return text.encode("utf-8", "replace").split() if text else []


def lower_words(text: str | None) -> list[bytes]:
    """``words`` with A-Z in lower case; bytes.lower leaves all other bytes alone."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def n_words(text: Column) -> Column:
    """Number of ``WORD`` matches; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def held(key: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; false for a null id."""
    return F.coalesce(F.crc32(key.cast("string")) % modulus == remainder, F.lit(False))


def learned(key: Column, modulus: int, remainder: int) -> Column:
    """Rows a model may learn from: a known id that is not held out."""
    return F.coalesce(F.crc32(key.cast("string")) % modulus != remainder, F.lit(False))


def bounded_sample(df: DataFrame, key: str, rows: int, seed: int, per: str) -> DataFrame:
    """About ``rows`` rows of each value of ``per`` (all, if fewer), by seeded hash of the key; the same on every run.

    Only the counts per value are shuffled; ``per`` is a label with few values.
    """
    place = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key)), 11) / F.lit(float(1 << 53))
    rates = {r[0]: rows / r[1] for r in df.groupBy(per).count().collect() if r[0] is not None}
    if not rates:
        return df.limit(0)
    rate = F.create_map(*[F.lit(x) for item in rates.items() for x in item])[F.col(per)]
    return df.where(place < rate)


def rows_where(docs: DataFrame, text: str, verdict: Callable[[list], list]) -> DataFrame:
    """Rows of ``docs`` whose text passes; verdict takes a list of texts. All columns pass through as they are."""

    def keep(batches):
        import pyarrow as pa

        for batch in batches:
            yield batch.filter(pa.array(verdict(batch.column(text).to_pylist()), pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def byte_of_character() -> dict[str, int]:
    """The public byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest follow from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def uneven(text: str) -> bool:
    """Whether a space stands at an end of the text or beside more white space."""
    if text[:1] == " " or text[-1:] == " " or "  " in text:
        return True
    return any(c + " " in text or " " + c in text for c in OTHER_SPACE if c in text)


class ByteBpe:
    """Ids of whole texts under a byte-level BPE file, with a bounded memory of pieces.

    Its pre-tokenizer always cuts before a lone space between two characters that are not white space. So a text falls
    into space-led pieces that are encoded apart and remembered; a text with other runs of spaces is encoded at once.
    With ``added`` a text is first cut at the file's added tokens, which give their own ids, as the library does by default.
    """

    #: the pre-tokenizer's public pattern (fixed value)
    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, tokenizer_json: str, added: bool = False):
        import re

        import numpy as np
        import tiktoken

        spec = json.loads(tokenizer_json)
        tokens = spec.get("added_tokens", [])
        special = {t["content"] for t in tokens}
        if added and any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in tokens):
            raise ValueError("added tokens that take white space or whole words are not supported")
        byte = byte_of_character()
        ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.bpe = tiktoken.Encoding("byte-bpe", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = 1 + max([*spec["model"]["vocab"].values(), *(t["id"] for t in tokens)])
        #: added tokens, the longest first, and their ids
        self.cut = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if added and special else None
        self.own = {t["content"]: np.array([t["id"]], np.dtype("<u2" if self.size <= 1 << 16 else "<u4")).tobytes() for t in tokens}
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.leads = np.zeros(self.size, bool)
        self.leads[[i for t, i in ranks.items() if t[:1] == b" "]] = True
        self.known: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        import numpy as np

        return np.array(self.bpe.encode_ordinary(text), self.kind).tobytes()

    def learn(self, pieces: set[str]) -> None:
        """Encode new pieces in one call; a piece's ids begin at the id whose bytes begin with a space."""
        import numpy as np

        if len(self.known) + len(pieces) > CACHE_ENTRIES:
            self.known.clear()
        ordered = list(pieces)
        ids = np.array(self.bpe.encode_ordinary(" " + " ".join(ordered)), self.kind)
        cuts = np.append(np.flatnonzero(self.leads[ids]), len(ids)) * self.kind.itemsize
        data, cuts = ids.tobytes(), cuts.tolist()
        self.known.update(zip(ordered, [data[a:b] for a, b in itertools.pairwise(cuts)], strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text as little-endian bytes of ``kind``."""
        if self.cut is None:
            return self.plain(texts)
        found = [self.cut.findall(t) for t in texts]
        if not any(found):
            return self.plain(texts)
        parts = self.plain([p for t in texts for p in self.cut.split(t)])
        out, at = [], 0
        for marks in found:
            own = [parts[at]]
            for k, mark in enumerate(marks, at + 1):
                own += [self.own[mark], parts[k]]
            out.append(b"".join(own))
            at += len(marks) + 1
        return out

    def plain(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without regard to added tokens."""
        split, unknown, known = [], set(), self.known
        if len(known) > CACHE_ENTRIES // 2:
            known.clear()
        for text in texts:
            pieces = None if uneven(text) else text.split(" ")
            split.append(pieces)
            if pieces:
                unknown.update(pieces[1:])
        unknown.difference_update(known)
        if unknown:
            self.learn(unknown)
        return [
            self.whole(text) if pieces is None else self.whole(pieces[0]) + b"".join(map(known.__getitem__, pieces[1:]))
            for text, pieces in zip(texts, split, strict=True)
        ]
