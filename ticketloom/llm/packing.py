"""Packing into sequences: first-fit decreasing over a tournament tree of free capacities, in randomised groups.

A document's ids are cut at multiples of the sequence length; the pieces of a group are placed, longest first, into the
first sequence that has room. The group of a piece is a hash, so groups need no order and are packed apart; their number
follows the number of rows, so a group stays small. Ids never leave the task that made them: only lengths are shuffled.

Cases: null and empty texts are the closing id alone; a null id is packed like any other; a repeated row is packed once
per row; equal lengths are placed in the order of id, start and crc; an empty table gives no row. Other columns of the
input, whatever their names, are ignored.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

#: Parameters: ids in a sequence, id that closes a document, rows of a group on average, words whose ids a task keeps.
SEQUENCE, CLOSING, GROUP_ROWS, CACHED_WORDS = 4096, 2, 4000, 250_000
#: The settings of a tokenizer that lower-cases and splits as `_words` does. With them, texts of `_plain`
#: characters only are split into the tokenizer's own words here, so that a word is encoded once for all its occurrences;
#: any other text, one that holds an added token, and all texts of other tokenizers go to the tokenizer whole.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
_plain = re.compile("[\t-\r -~À-ÖØ-öø-ÿ]*").fullmatch
_words = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\t-\r a-zß-öø-ÿ0-9]+").findall


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """text -> ids as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Words are encoded alone only where no added token (<|endoftext|>, in any case) stands in the text.
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        settings = json.loads(self.tokenizer.to_str())
        cut = settings.get("pre_tokenizer") or {}
        self.by_words = settings.get("normalizer") == _NORMALIZER and [s for s in cut.get("pretokenizers", []) if s["type"] != "ByteLevel"] == [_SPLIT]
        self.known: dict[str, bytes] = {}

    @staticmethod
    def _bytes(ids: list[int]) -> bytes:
        a = array("I", ids)
        if sys.byteorder == "big":
            a.byteswap()
        return a.tobytes()

    def _learn(self, words: list[str]) -> None:
        """Encode words, a blank between them, 400 at a time."""
        for k in range(0, len(words), 400):
            some = words[k : k + 400]
            got = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            ids = self._bytes(got.ids)
            starts = [a for a, _ in got.offsets]
            at = 0
            end = 0
            for w in some:
                first, end = at, end + len(w)
                while at < len(starts) and starts[at] < end:
                    at += 1
                self.known[w] = ids[4 * first : 4 * at]
                end += 1

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        split = [_words(low) if self.by_words and t and _plain(t) and not any(a in (low := t.lower()) for a in self.added) else None for t in texts]
        new = {w for s in split if s for w in s}.difference(self.known)
        self._learn(list(new))
        get = self.known.__getitem__
        return [
            b"".join(map(get, s)) if s is not None else self._bytes(self.tokenizer.encode(t, add_special_tokens=False).ids) if t else b""
            for t, s in zip(texts, split, strict=True)
        ]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, size: int = SEQUENCE) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): each document's ids cut into pieces of at most `size`."""
    path = tokenizer or default_tokenizer()
    bounded_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[doc_id]
    closing = int(CLOSING).to_bytes(4, "little")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path).encode
        for p in parts:
            rows = []
            for i, ids in zip(p["doc_id"], encode(list(p["t"])), strict=True):
                ids += closing
                n = len(ids) // 4
                rows += [(i, k, min(size, n - k), zlib.crc32(ids[4 * k : 4 * (k + size)]), n) for k in range(0, n, size)]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t")).mapInPandas(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def first_fit(lengths: list[int], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, which must fall; a tree over the bins holds the largest free room below each node."""
    leaves = 1
    while leaves < len(lengths):
        leaves *= 2
    room = [size] * (2 * leaves)
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i, n in enumerate(lengths):
        k = 1
        while k < leaves:
            k *= 2
            if room[k] < n:
                k += 1
        where[i], offset[i] = k - leaves, size - room[k]
        room[k] -= n
        while k > 1:
            k //= 2
            room[k] = max(room[2 * k], room[2 * k + 1])
    return where, offset


def pack(cut: DataFrame, groups: int, size: int = SEQUENCE) -> DataFrame:
    """The pieces with sequence_id and offset; ids of sequences are unique, not dense."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable", na_position="first")
        where, offset = first_fit(p["length"].tolist(), size)
        return p.assign(sequence_id=p["pack_group"] * (1 << 32) + where, offset=offset).drop(columns="pack_group")

    # The place of a row in its input tells repeated rows apart, so that many copies of one row don't share a group.
    dealt = cut.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "start", F.monotonically_increasing_id()), F.lit(groups)))
    kind = dict(cut.dtypes)["doc_id"]
    return dealt.groupBy("pack_group").applyInPandas(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, size: int = SEQUENCE, group_rows: int = GROUP_ROWS) -> DataFrame:
    return pack(pieces(docs, doc_id, text, tokenizer, size), max(1, round(docs.count() / group_rows)), size)
