"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

Texts up to LONG characters go to the library as they are. Longer ones are cut first at safe boundaries: before a
space between two characters that aren't white space, where no match of the pattern can span. A stretch without
such a boundary is cut into the pattern's own matches, which the library merges one by one. Null and empty texts have no
tokens; decoding joins the tokens' raw bytes.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import pandas as pd
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import prepare, text_bytes

#: Characters up to which a text is given to the library whole.
LONG = 65_536
SAFE = regex.compile(r"(?<=\S)(?= \S)")


class ByteBpe:
    """encode(text) -> ids and decode(ids) -> bytes for mergeable ranks and a splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.matches = regex.compile(pattern)
        self.library = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if len(text) <= LONG:
            return self.library.encode_ordinary(text)
        ids: list[int] = []
        for part in self.segments(text):
            if len(part) <= LONG:
                ids += self.library.encode_ordinary(part)
            else:
                for m in self.matches.finditer(part):
                    ids += self.library._core_bpe.encode_single_piece(m.group().encode())
        return ids

    def segments(self, text: str):
        """Pieces of about LONG characters, cut at safe boundaries only."""
        at = 0
        while len(text) - at > LONG:
            cut = text.rfind(" ", at + 1, at + LONG)
            while cut > at and (text[cut - 1].isspace() or text[cut + 1].isspace()):
                cut = text.rfind(" ", at + 1, cut)
            if cut <= at:
                m = SAFE.search(text, at + 1)
                cut = m.start() if m else len(text)
            yield text[at:cut]
            at = cut
        yield text[at:]

    def decode(self, ids: list[int]) -> bytes:
        return self.library.decode_bytes(ids)


@lru_cache(maxsize=4)
def load(path: str, pattern: str) -> ByteBpe:
    with open(path, "rb") as f:
        return ByteBpe({base64.b64decode(t): int(r) for t, r in map(bytes.split, filter(bytes.strip, f))}, pattern)


@lru_cache(maxsize=4)
def decimals(size: int) -> list[str]:
    return [str(i) for i in range(size)]


def encode_column(text: Column, path: str, pattern: str) -> Column:
    """array<int> of a text column's ids."""

    @F.pandas_udf("array<int>")
    def encode(texts: pd.Series) -> pd.Series:
        bpe = load(path, pattern)
        return pd.Series([bpe.encode(t or "") for t in texts])

    return encode(text)


def decode_column(ids: Column, path: str, pattern: str) -> Column:
    """The raw bytes of an array<int> column; ids that end inside a character stay as they are."""

    @F.pandas_udf("binary")
    def decode(rows: pd.Series) -> pd.Series:
        bpe = load(path, pattern)
        return pd.Series([None if r is None else bpe.decode([int(i) for i in r]) for r in rows])

    return decode(ids)


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: digests of the ids and of the bytes decoded from them.

    One narrow pass. Rows of equal ids or texts are encoded each for itself; other columns are not read; an empty table
    gives no rows."""
    prepare(docs.sparkSession)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(texts: pd.Series) -> pd.DataFrame:
        bpe = load(path, pattern)
        name = decimals(bpe.library.n_vocab)
        rows = []
        for t in texts:
            ids = bpe.encode(t)
            rows.append((len(ids), hashlib.sha256(",".join([name[i] for i in ids]).encode()).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(doc_id).alias("doc_id"), digest(text_bytes(text)).alias("d")).select("doc_id", "d.*")
