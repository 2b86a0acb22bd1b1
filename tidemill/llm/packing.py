"""Packing token sequences in bounded space, online.

Every partition keeps a fixed number of open windows. A document longer than a window is cut into
full windows and a rest; a rest goes to the open window that it fits best. When none fits, the
fullest window is topped up with the start of the piece, unless only a few places are left, and goes
out; the remaining piece is placed again. Windows still open at the end of a partition are the
leftovers: their pieces move on to fewer tasks, which pour them one after another into full windows.

Token ids are those of the tokenizers library. A text is cut at its spaces into chunks, these by
byte-level BPE's pre-tokenisation pattern into pieces, and a worker lets the library's model encode each
distinct piece once, as pieces are encoded independently.
A text that holds an added token's content, such as <|endoftext|>, has that token's id there, as the library has it.

Defined results: a null or empty text is a document of one token, the end mark; repeated rows are
documents of their own; a null id is kept; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import json
import os
import re
import sys
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.shared import small_batches, table, written

SIZE, OPEN, TOP_UP = 2048, 32, 16
END_ID = 1
PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"
_NAMES = [x.split()[0] for x in PIECE.split(", ")]
_TYPES = [pa.int64()] * 7 + [pa.binary()]


def _odd_characters() -> str:
    """Numbers that aren't decimal digits, and separators, on which Python's classes and the tokenizer's differ."""
    return "".join(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) in ("No", "Nl") or "\x1c" <= c <= "\x1f" or c == "\u180e")


def _byte_alphabet() -> dict[int, str]:
    """Byte-level BPE's letters: printable bytes stand for themselves, the others for the letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder(dict):
    """ids of texts, equal to the library's own.

    As a dictionary it numbers the distinct chunks that it has met: what stands between two spaces of a
    text, with the space before it, or, marked by a leading space, a chunk that starts a text. The library's
    model encodes each distinct piece of a chunk once. Beyond `most` chunks or `most_bytes` of what they take it
    starts afresh, and texts with a chunk of over LONG characters are cut as a whole, so that none is kept.
    """

    LONG = 64

    def __init__(self, path: str, most: int = 1_600_000, most_bytes: int = 1 << 27) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        step = spec.get("pre_tokenizer") or {}
        self.simple = step.get("type") == "ByteLevel" and step.get("use_regex", True) and not step.get("add_prefix_space") and not spec.get("normalizer")
        # The pre-tokenisation pattern of byte-level BPE in Python's classes; chunks with characters that these class otherwise go to the library whole.
        self.cut = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]+|_+)+|\s+(?!\S)|\s+").findall
        self.odd = frozenset(_odd_characters())
        # Added tokens, such as the end mark, are found in the text before it is cut; texts that hold one go to the library whole too.
        self.added = [t["content"] for t in spec.get("added_tokens") or ()]
        self.letters = _byte_alphabet()
        self.space = self.letters[32]
        self.model, self.most, self.most_bytes = self.tokenizer.model, most, most_bytes
        self._forget()

    def _forget(self) -> None:
        self.clear()
        self.pieces: dict[str, bytes] = {}
        self.fresh: list[str] = []
        self.first, self.count, self.unsafe = (np.empty(0, t) for t in (np.int64, np.int64, bool))
        self.flat, self.used, self.held = np.empty(0, np.uint32), 0, 0

    def _plain(self, text: str) -> bool:
        """Whether the library has nothing to find in the text but pieces that Python's pattern finds too."""
        return self.simple and self.odd.isdisjoint(text) and not any(a in text for a in self.added)

    def _piece(self, piece: str) -> bytes:
        got = self.pieces.get(piece)
        if got is None:
            # Letters and a space before them need no byte by byte translation where they are ASCII.
            plain = piece.isascii() and piece[1:].isalpha() and piece[0] == " "
            letters = f"{self.space}{piece[1:]}" if plain else piece.encode().decode("latin-1").translate(self.letters)
            got = array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
            if len(piece) <= self.LONG:
                self.pieces[piece] = got
                self.held += 200 + len(piece) + len(got)  # two objects and an entry of a dictionary
        return got

    def _cut(self, text: str) -> bytes:
        """The ids of a plain text; each piece is encoded once. A word, and a word with a sign behind it, need no search for pieces."""
        word = text[1:]
        if text[:1] == " " and word.isalpha():
            return self._piece(text)
        if text[:1] == " " and word[-1:] in (".", ",") and word[:-1].isalpha():
            return self._piece(text[:-1]) + self._piece(text[-1])
        return b"".join(map(self._piece, self.cut(text)))

    def _whole(self, text: str) -> bytes:
        """The ids of a text as unsigned 32-bit numbers, one after another."""
        return self._cut(text) if self._plain(text) else array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, chunk: str) -> int:
        n = self[chunk] = len(self)
        self.fresh.append(chunk)
        return n

    def _learn(self) -> None:
        """Encodes the chunks that were met for the first time."""
        texts = [c[1:] if c.startswith(" ") else f" {c}" for c in self.fresh]
        whole = self._cut if self._plain("".join(texts)) else self._whole
        got = [whole(t) for t in texts]
        count = np.fromiter(map(len, got), np.int64, len(got)) // 4
        self.held += sum(map(len, self.fresh)) + sum(map(len, got)) + 200 * len(got)
        self.first = np.concatenate((self.first, self.used + np.cumsum(count) - count))
        self.count = np.concatenate((self.count, count))
        # White space after a space may belong to one piece with white space before it.
        self.unsafe = np.concatenate((self.unsafe, np.fromiter((not c or c[0] != " " and c[0].isspace() for c in self.fresh), bool, len(got))))
        new = np.frombuffer(b"".join(got), np.uint32)
        if self.used + len(new) > len(self.flat):  # grows by doubling
            grown = np.empty(2 * (self.used + len(new)), np.uint32)
            grown[: self.used] = self.flat[: self.used]
            self.flat = grown
        self.flat[self.used : self.used + len(new)] = new
        self.used += len(new)
        self.fresh = []

    def ids(self, texts: list[str], end: int | None = None) -> list[np.ndarray]:
        """The ids of each text, and the end id behind them.

        Spaces that no white space follows start a piece, so chunks are encoded independently; a text with
        another space is cut by the pattern as a whole.
        """
        if len(self) > self.most or len(self.pieces) > self.most or self.held > self.most_bytes:
            self._forget()
        last = np.array([] if end is None else [end], np.uint32)
        whole_text = lambda t: np.append(np.frombuffer(self._whole(t), np.uint32), last)
        if not self.simple:
            return [whole_text(t) for t in texts]
        chunks, counts = [], []
        for text in texts:
            own = text.split(" ")
            own[0] = f" {own[0]}"
            if max(map(len, own)) > self.LONG:
                own = ["\t"]  # unsafe: the text is cut as a whole
            chunks += own
            counts.append(len(own))
        which = np.fromiter(map(self.__getitem__, chunks), np.int64, len(chunks))
        if self.fresh:
            self._learn()
        ends = np.cumsum(counts)
        whole = np.bincount(np.searchsorted(ends, np.flatnonzero(self.unsafe[which]), side="right"), minlength=len(texts))
        each = self.count[which]
        to = np.cumsum(each)
        flat = self.flat[np.repeat(self.first[which] - to + each, each) + np.arange(int(to[-1]) if len(to) else 0)]
        out, at = [], 0
        for text, stop, odd in zip(texts, to[ends - 1].tolist() if texts else [], whole.tolist(), strict=True):
            if odd or any(a in text for a in self.added):
                out.append(whole_text(text))
            else:
                out.append(np.append(flat[at:stop], last))
            at = stop
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this worker, which later tasks find as earlier ones left it."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _rows(pieces: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*pieces, strict=True), _TYPES, strict=True)], _NAMES)


def _out(window: list[tuple], sequence: int | None, with_ids: bool) -> list[tuple]:
    """Rows of a window's pieces (doc, start, ids, doc_tokens); no sequence: leftovers, with their ids."""
    rows, offset = [], 0
    for doc, start, ids, total in window:
        raw = ids.astype("<u4").tobytes()
        rows.append((doc, start, len(ids), zlib.crc32(raw), total, sequence, offset, raw if with_ids or sequence is None else None))
        offset += len(ids)
    return rows


class Packer:
    """The open windows of one partition."""

    def __init__(self, size: int, most: int, top_up: int) -> None:
        self.size, self.most, self.top_up = size, most, top_up
        self.windows: list[list[tuple]] = []
        self.free: list[int] = []

    def add(self, doc: int, ids: np.ndarray, start: int = 0, total: int | None = None) -> Iterator[list[tuple]]:
        """Places a document's ids; yields the windows that go out."""
        total, at, n = total if total is not None else len(ids), 0, len(ids)
        while n - at >= self.size:
            yield [(doc, start + at, ids[at : at + self.size], total)]
            at += self.size
        while at < n:
            need = n - at
            fits = [f for f in self.free if f >= need]
            if fits:
                i = self.free.index(min(fits))
            elif len(self.free) < self.most:
                self.windows.append([])
                self.free.append(self.size)
                i = len(self.free) - 1
            else:
                i = self.free.index(min(self.free))
                if self.free[i] >= self.top_up:
                    end = at + self.free[i]
                    self.windows[i].append((doc, start + at, ids[at:end], total))
                    at = end
                yield self._pop(i)
                continue
            self.windows[i].append((doc, start + at, ids[at:n], total))
            self.free[i] -= need
            at = n
            if not self.free[i]:
                yield self._pop(i)

    def _pop(self, i: int) -> list[tuple]:
        self.free.pop(i)
        return self.windows.pop(i)


def _pack(batches: Iterator[pa.RecordBatch], path: str, size: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    encode, packer = encoder(path), Packer(size, OPEN, TOP_UP)
    sequence, rows = TaskContext.get().partitionId() << 33, []
    for b in batches:
        for doc, ids in zip(b.column(0).to_pylist(), encode.ids(b.column(1).to_pylist(), END_ID), strict=True):
            for window in packer.add(doc, ids):
                rows += _out(window, sequence, with_ids)
                sequence += 1
        if len(rows) > 4096:
            yield _rows(rows)
            rows = []
    rows += [r for w in packer.windows for r in _out(w, None, True)]
    if rows:
        yield _rows(rows)


def _pour(batches: Iterator[pa.RecordBatch], size: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """Fills one window after another with leftover pieces."""
    sequence, window, free = (1 << 62) + (TaskContext.get().partitionId() << 33), [], size
    for b in batches:
        rows = []
        for doc, start, total, raw in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            ids, at = np.frombuffer(raw, "<u4"), 0
            while at < len(ids):
                part = ids[at : at + free]
                window.append((doc, start + at, part, total))
                at, free = at + len(part), free - len(part)
                if not free:
                    rows += _out(window, sequence, with_ids)
                    sequence, window, free = sequence + 1, [], size
        if rows:
            yield _rows(rows)
    if window:
        yield _rows(_out(window, sequence, with_ids))


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, with_ids: bool = True, leftovers_a_task: int = 64 * OPEN) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids (little-endian 32 bit).

    Leftovers are at most OPEN windows a partition; a task of the second step pours as many ids as
    `leftovers_a_task` windows hold.
    """
    spark = docs.sparkSession
    small_batches(spark)
    first = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    first = written(first.mapInArrow(lambda it: _pack(it, tokenizer, size, with_ids), PIECE), "packed")
    left = first.where("sequence_id is null")
    tokens = left.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, round(tokens / size / leftovers_a_task))
    poured = left.select("doc_id", "start", "doc_tokens", "ids").repartition(tasks, F.col("doc_id")).sortWithinPartitions("doc_id", "start", "doc_tokens", "ids")
    poured = written(poured.mapInArrow(lambda it: _pour(it, size, with_ids), PIECE), "poured")
    out = first.where("sequence_id is not null").unionByName(poured)
    return out if with_ids else out.drop("ids")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), default_tokenizer(), with_ids=False)
