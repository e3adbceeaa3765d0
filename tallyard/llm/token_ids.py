"""Token ids of whole corpora by a public byte-level BPE, joined up a tree of text halves."""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Characters up to which a text is encoded in one go.
LEAF_CHARS = 1024
#: Largest vocabulary file that is sent to the executors.
MAX_VOCABULARY_BYTES = 64 << 20
# Fixed value: the pattern that cuts text into the pieces inside which the vocabulary's merges apply.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: No alternative of PIECES looks further than this from a piece's start without being ended by the next character.
_REACH = 4


@dataclass(frozen=True)
class Encoded:
    """An encoded stretch of text: the monoid's element."""

    text: str
    ids: list[int]


class TreeEncoder:
    """Encodes long texts by halves; joining re-encodes only a window around the border.

    A piece is found from its start by looking forward only, so two segmentations that share one piece start
    agree from there on. Left of the window: the last piece start of the left half that no character beyond the
    half can move. Right: the window grows piece by piece until a piece start of the joined text is also one of
    the right half's own; from there the right half's ids hold. So the result equals encoding the whole text.
    """

    def __init__(self, vocabulary: bytes, leaf_chars: int = LEAF_CHARS):
        import regex
        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines())}
        self.bpe = tiktoken.Encoding("public", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        self.pieces = regex.compile(PIECES)
        self.leaf_chars = max(2 * _REACH, leaf_chars)

    def encode(self, text: str) -> list[int]:
        return self._reduce(text).ids if text else []

    def _reduce(self, text: str) -> Encoded:
        if len(text) <= self.leaf_chars:
            return Encoded(text, self.bpe.encode_ordinary(text))
        half = len(text) // 2
        return self.join(self._reduce(text[:half]), self._reduce(text[half:]))

    def _count(self, pieces: list[str]) -> int:
        return sum(len(self.bpe._encode_single_piece(p)) for p in pieces)

    def _settled_start(self, text: str) -> int:
        """The last piece start of text that stays one whatever follows text."""
        window = 64
        while True:
            # a start found in a window is a start of the text if the scan met a piece start of the text before;
            # growing to the whole text makes that certain in any case
            begin = self._anchor(text, window)
            last = begin
            for m in self.pieces.finditer(text, begin):
                if m.start() > len(text) - _REACH:
                    break
                last = m.start()
            if last > begin or begin == 0:
                return last
            window *= 4

    @staticmethod
    def _anchor(text: str, window: int) -> int:
        """A sure piece start at least window characters before the end: between a letter and white space that a letter follows."""
        for i in range(len(text) - window, 0, -1):
            if text[i] == " " and text[i - 1].isalpha() and text[i + 1 : i + 2].isalpha():
                return i
        return 0

    def join(self, left: Encoded, right: Encoded) -> Encoded:
        start = self._settled_start(left.text)
        tail = [m.group() for m in self.pieces.finditer(left.text, start)]
        text = left.text + right.text
        border = len(left.text)
        joined = self.pieces.finditer(text, start)
        own = self.pieces.finditer(right.text)
        window, head, at, right_at = [], [], start, 0
        while at < len(text):
            if at >= border:
                while right_at < at - border:
                    m = next(own)
                    head.append(m.group())
                    right_at = m.end()
                if right_at == at - border:
                    break
            m = next(joined)
            window.append(m.group())
            at = m.end()
        middle = [i for p in window for i in self.bpe._encode_single_piece(p)]
        kept = left.ids[: len(left.ids) - self._count(tail)]
        rest = right.ids[self._count(head) :] if at < len(text) else []
        return Encoded(text, kept + middle + rest)

    def decode(self, ids: list[int]) -> str:
        """The text of ids; halves are decoded to bytes and concatenated up the tree. Ids that spell no valid UTF-8 give U+FFFD."""

        def spell(part: list[int]) -> bytes:
            if len(part) <= self.leaf_chars:
                return self.bpe.decode_bytes(part)
            half = len(part) // 2
            return spell(part[:half]) + spell(part[half:])

        return spell(list(ids)).decode("utf-8", errors="replace")


_encoders: dict[tuple[str, int], TreeEncoder] = {}


def _encoder(vocabulary: bytes, leaf_chars: int) -> TreeEncoder:
    key = (hashlib.sha256(vocabulary).hexdigest(), leaf_chars)
    if key not in _encoders:
        _encoders[key] = TreeEncoder(vocabulary, leaf_chars)
    return _encoders[key]


def _vocabulary(df: DataFrame, folder: str, name: str):
    path = os.path.join(folder, name)
    if os.path.getsize(path) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode_corpus(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, vocabulary: str = VOCABULARY, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """(doc_id, ids) of every row; the ids of a null or empty text are an empty list.

    Strings of special tokens are ordinary text. Rows are independent, so there is no shuffle; texts of any length
    are encoded whole. Repeated rows come out as often as they come in.
    """
    sent = _vocabulary(documents, folder, vocabulary)
    narrow = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(sent.value, leaf_chars)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": [encoder.encode(t) if t else [] for t in batch["text"]]})

    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInPandas(run, f"doc_id {kind}, ids array<int>").withColumnRenamed("doc_id", doc_id)


def decode_corpus(encoded: DataFrame, doc_id: str = "doc_id", ids: str = "ids", folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of every row of ids; a null or empty list gives an empty text."""
    sent = _vocabulary(encoded, folder, vocabulary)
    narrow = encoded.select(F.col(doc_id).alias("doc_id"), F.col(ids).alias("ids"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(sent.value, LEAF_CHARS)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": [encoder.decode(x) if x is not None else "" for x in batch["ids"]]})

    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInPandas(run, f"doc_id {kind}, text string").withColumnRenamed("doc_id", doc_id)
