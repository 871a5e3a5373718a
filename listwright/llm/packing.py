"""Packing by powers of two.

A document's tokens and one end token are cut into pieces of ``MAX`` tokens and, for the rest, one piece for each bit
of its length, longest first. Every piece is a sequence of its own, so none crosses documents and none needs padding;
sequences of equal length form a bucket, from which batches without padding are drawn (``write_buckets``).

Tokens of this vocabulary lie within the pieces of a pattern, so the ids of short pieces are looked up in a bounded table
per task; pieces not in it are encoded by the tokenizer's model.

Defined cases: null text is empty text and gives one piece with the end token; repeated rows are packed each for
itself; other columns are ignored; an empty table gives no rows. ``sequence_id`` is unique in the result.
"""

from __future__ import annotations

import re
from struct import pack as pack_ints
from zlib import crc32

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listwright.llm.common import map_rows

VOCABULARY = "word_bpe_49k.json"
END, MAX = 1, 2048
#: Longer pieces are not kept in the table; beyond so many pieces a task starts a new table.
KEPT_CHARS, KEPT_PIECES = 32, 200_000
_PLAIN, _SEPARATOR = re.compile(r"[\t-\r -~À-ÖØ-öø-ÿ]*"), re.compile(r"[\x1c-\x1f]")
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9\t-\r ]+")
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids array<int>"


class Encoder(dict):
    """Ids as little-endian unsigned 32-bit numbers, by piece, for this vocabulary's rules.

    Texts of printable ASCII, Latin-1 letters and ASCII white space are lower-cased and split here by the tokenizer's own
    pattern, and only its model is asked, once for each piece in the table. Of other texts the parts between white
    space that are plain are handled so, the others go through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        # The byte alphabet of byte-level vocabularies: printable bytes stand for themselves, the others follow from 256 on.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = (b for b in range(256) if b not in printable)
        self.letters = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}

    def __missing__(self, piece: str) -> bytes:
        text = piece if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode()))
        ids = [t.id for t in self.tokenizer.model.tokenize(text)]
        found = pack_ints(f"<{len(ids)}I", *ids)
        if len(piece) <= KEPT_CHARS:
            if len(self) >= KEPT_PIECES:
                self.clear()
            self[piece] = found
        return found

    def plain(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, _PIECE.findall(text.lower())))

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if "<|" in text:  # may be the string of a special token
            return self.whole(text)
        if _PLAIN.fullmatch(text):
            return self.plain(text)
        # Python takes the separators \x1c-\x1f for white space, the tokenizer doesn't.
        if _SEPARATOR.search(text):
            return self.whole(text)
        return b"".join(self.plain(part) if _PLAIN.fullmatch(part) else self.whole(part) for part in text.split())


def lengths(tokens: int, most: int) -> list[int]:
    """The pieces' lengths: whole sequences, then the set bits of what is left."""
    rest = tokens % most
    return [most] * (tokens // most) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def pack(docs: DataFrame, path: str | None = None, most: int = MAX, end: int = END, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, ids (null without ``with_ids``), sequence_id, offset."""
    if most < 1 or most & (most - 1):
        raise ValueError("the longest sequence must be a power of two")
    path = path or public_tokenizers.path(VOCABULARY)

    def make():
        encoder, last = Encoder(path), np.array([end], "<u4").tobytes()

        def work(doc_ids, texts):
            rows: list[tuple] = []
            for doc_id, text in zip(doc_ids, texts):
                ids = encoder.encode(text or "") + last
                start, total = 0, len(ids) // 4
                for n in lengths(total, most):
                    part = ids[4 * start : 4 * (start + n)]
                    rows.append((doc_id, start, n, crc32(part), total, np.frombuffer(part, "<i4") if with_ids else None))
                    start += n
                if len(rows) >= (1_000 if with_ids else 20_000):
                    yield rows
                    rows = []
            yield rows

        return work

    pieces = map_rows(docs.selectExpr("cast(doc_id as long) doc_id", "text"), make, SCHEMA)
    return pieces.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """One folder per sequence length; rows of a folder are stacked into batches without padding."""
    pieces.write.partitionBy("length").parquet(path)
