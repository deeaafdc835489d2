"""Token ids by the tokenizers library, faster on natural text by remembering pieces.

A text is cut only where every pre-tokenizer in use starts a new piece anyway, whatever stands around
it: before a single space between two visible characters, and between a Latin letter and ASCII
punctuation. Each piece is then encoded by the library once and remembered, so that frequent words
cost a lookup. Where white space only separates words, Arrow splits texts into pieces, tells those of many
texts apart and puts their ids together, so that only distinct pieces are looked up. The ids equal those of
the whole text; a tokenizer whose set-up is not known to respect such cuts is given whole texts, and so is
any tokenizer with a text that may hold the string of an added token.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import SparkSession

# Letters and ASCII punctuation that never share a piece; anything else stays with its surroundings.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_MARKS = r"!-/:-@\[-`{-~"
PIECES = re.compile(rf" ?[{_LETTERS}]+(?=[{_MARKS}]| \S|\Z)| ?[{_MARKS}]+(?= \S|\Z)"
                    r"|(?s:.)+?(?=(?<=\S) \S|\Z)")
# Pieces that both kinds of pre-tokenizer keep whole, and that never hold a digit.
RUN = re.compile(rf" ?(?:[{_LETTERS}]+|[{_MARKS}]+)")
pack_ids = [struct.Struct(f"<{n}I").pack for n in range(16)]
MOST_PIECES = 600_000      # remembered in one worker process, about 130 MB
# The same characters as bytes of UTF-8: ASCII letters and marks, and what follows 0xC3 in a letter from À to ÿ.
IS_LETTER, IS_MARK, IS_LATIN = (np.isin(np.arange(256), [*some]) for some in (
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~",
    {*range(0x80, 0xC0)} - {0x97, 0xB7}))


def share_tokenizer(spark: SparkSession, path: str) -> Broadcast:
    """The tokenizer's file (1 to 2 MB, whatever the data) as a broadcast, read once on the driver."""
    with open(path, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


def _cuts_are_safe(text: str) -> bool:
    """Whether pieces may be encoded apart: byte-level splits, no context-sensitive normalizers."""
    spec = json.loads(text)
    normalizer, splitter = spec.get("normalizer"), spec.get("pre_tokenizer") or {}
    parts = [] if normalizer is None else normalizer.get("normalizers", [normalizer])
    safe = all(p["type"] in ("NFC", "Lowercase")
               or p == {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "} for p in parts)
    steps = splitter.get("pretokenizers", [splitter])
    first = steps[0] if steps else {}
    byte_level = first.get("type") == "ByteLevel" and first.get("use_regex") and not first["add_prefix_space"]
    # Words of letters, single digits, runs of other visible characters; white space is dropped.
    words = (first.get("type") == "Split" and first.get("invert") and first.get("behavior") == "Removed"
             and first["pattern"].get("Regex", "").endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"))
    special = all(t["special"] for t in spec.get("added_tokens", []))
    return bool(safe and special and (byte_level or words) and spec["model"].get("dropout") is None)


class Encoder:
    """Encodes lists of texts into little-endian unsigned 32-bit ids; one per process and tokenizer."""

    _known: dict[int, "Encoder"] = {}

    def __init__(self, spec: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_str(spec)
        self.by_piece = _cuts_are_safe(spec)
        added = [token["content"] for token in json.loads(spec).get("added_tokens", [])]
        # Added tokens are looked for in whole texts, whatever their case; the search for what they begin with is fast.
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)", re.IGNORECASE)
        self.openings = {re.match(r"[^\w\s]*", content)[0] for content in added}
        self.known: dict[str, bytes] = {}
        self.words = self.by_piece and json.loads(spec)["normalizer"] is not None
        if self.by_piece and hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)      # pieces are remembered here, a second memory only costs time
        # How the byte-level step writes the characters of runs; words also lose their case.
        step = ByteLevel(add_prefix_space=False, use_regex=False)
        runs = [chr(c) for c in range(0x20, 0x100) if RUN.fullmatch(chr(c))]
        self.letters = {ord(c): step.pre_tokenize_str(c)[0][0] for c in [" ", *runs]}

    @classmethod
    def of(cls, spec: str) -> "Encoder":
        key = hash(spec)
        if key not in cls._known:
            cls._known[key] = cls(spec)
        return cls._known[key]

    def _library(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [struct.pack(f"<{len(ids)}I", *ids) for ids in (e.ids for e in found)]

    def _learn(self, new: list[str]) -> None:
        """Encode new pieces. A run of letters or marks is one pre-token and goes to the model directly."""
        runs, rest = [], []
        for piece in new:
            (runs if RUN.fullmatch(piece) else rest).append(piece)
        self.known.update(zip(rest, self._library(rest)))
        tokenize, letters, known = self.tokenizer.model.tokenize, self.letters, self.known
        for piece in runs:
            plain = piece.lower() if self.words else piece
            if not plain.isascii() or " " in plain:     # all else is written by the byte-level step as it is
                plain = plain.translate(letters)
            ids = [token.id for token in tokenize(plain)]
            known[piece] = pack_ids[len(ids)](*ids) if len(ids) < 16 else struct.pack(f"<{len(ids)}I", *ids)

    def _whole(self, text: str) -> bool:
        """Whether the library has to see the text whole: it may hold an added token."""
        return any(opening in text for opening in self.openings) and self.added.search(text) is not None

    @staticmethod
    def _plain(text: str) -> str:
        try:        # up to U+00FF no character's case or form depends on others, so fewer words are to be known
            text.encode("latin-1")
            return text.lower()
        except UnicodeEncodeError:
            return text

    def _pieces(self, texts: list[str]) -> pa.LargeListArray:
        """The words of texts, cut once more wherever a Latin letter stands before an ASCII mark."""
        plain = pa.array([self._plain(text) for text in texts], pa.large_string())
        _, offsets, data = plain.buffers()
        offsets, data = np.frombuffer(offsets, "<i8", len(texts) + 1), np.frombuffer(data or b"", "u1")
        letter = IS_LETTER[data]
        letter[1:] |= IS_LATIN[data[1:]] & (data[:-1] == 0xC3)
        cuts = np.flatnonzero(letter[:-1] & IS_MARK[data[1:]]) + 1
        cut = pa.LargeStringArray.from_buffers(
            len(texts), pa.py_buffer(offsets + np.searchsorted(cuts, offsets)), pa.py_buffer(np.insert(data, cuts, 0x20)))
        return pc.ascii_split_whitespace(cut)

    def _by_words(self, texts: list[str], remember: int) -> list[bytes]:
        pieces = self._pieces(texts)
        found = pieces.flatten().dictionary_encode()
        distinct = found.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) > remember:
            self.known.clear()
        here = list(map(self.known.get, distinct))
        self._learn([piece for piece, ids in zip(distinct, here) if ids is None])
        here = [self.known[piece] if ids is None else ids for piece, ids in zip(distinct, here)]
        ids = pa.array(here, pa.large_binary()).take(found.indices)
        _, offsets, data = ids.buffers()
        ends = np.frombuffer(offsets, "<i8", len(ids) + 1)[pieces.offsets.to_numpy()].tolist()
        data = memoryview(data or b"")
        return [bytes(data[start:end]) for start, end in zip(ends, ends[1:])]

    def encode(self, texts: list[str], remember: int = MOST_PIECES) -> list[bytes]:
        if not self.by_piece:
            return self._library(texts)
        whole = [i for i, text in enumerate(texts) if self._whole(text)]
        if whole:
            apart_from = set(whole)
            left = iter(self.encode([text for i, text in enumerate(texts) if i not in apart_from], remember))
            apart = dict(zip(whole, self._library([texts[i] for i in whole])))
            return [apart[i] if i in apart else next(left) for i in range(len(texts))]
        if self.words:
            return self._by_words(texts, remember)
        cut = [PIECES.findall(text) for text in texts]
        new = list(set().union(*cut).difference(self.known))
        if len(self.known) + len(new) > remember:
            self.known.clear()
            new = list(set().union(*cut))
        self._learn(new)
        known = self.known.__getitem__
        return [b"".join(map(known, pieces)) for pieces in cut]

    def batches(self, texts: list[str], most_chars: int | None = None, remember: int = MOST_PIECES
                ) -> Iterator[list[bytes]]:
        """`encode` over runs of texts of about `most_chars`, so that pieces in hand stay few."""
        most_chars = most_chars or (2_000_000 if self.words else 500_000)
        start = size = 0
        for i, text in enumerate(texts):
            size += len(text)
            if size >= most_chars:
                yield self.encode(texts[start:i + 1], remember)
                start, size = i + 1, 0
        if start < len(texts):
            yield self.encode(texts[start:], remember)
