"""Encoding with a public byte-level BPE vocabulary, by dynamic programming over prefixes."""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.sources.tables import ship

#: Words whose ids a worker remembers; beyond, it starts anew.
REMEMBERED = 1 << 18


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """The file of an installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    """The pattern that splits text into words before the merges."""
    import public_tokenizers

    return public_tokenizers.PATTERN


class PrefixEncoder:
    """Byte pair encoding of words from a file of ranks.

    For each prefix of a word one token only can be the last of its encoding: the token t that
    ends there such that the encoding of the part before t ends in a token s for which s, t stay
    apart when their bytes are merged by rank. So one pass stores that token per prefix, reading
    the ids is walking back from the end, and appended bytes extend the table without changing it.
    """

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes = {i: b for b, i in self.ranks.items()}
        self.lengths = sorted({len(b) for b in self.ranks})
        self.apart: dict[tuple[int, int], bool] = {}

    def merged(self, data: bytes) -> list[int]:
        """The ids of some bytes by merging the pair of lowest rank until none is left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def stay_apart(self, s: int, t: int) -> bool:
        known = self.apart.get((s, t))
        if known is None:
            if len(self.apart) > 1 << 20:
                self.apart.clear()
            known = self.apart[s, t] = self.merged(self.bytes[s] + self.bytes[t]) == [s, t]
        return known

    def extend(self, data: bytes, last: list[int], done: int) -> None:
        """last[j], the last token of the encoding of data[:j], for j from done + 1 on."""
        del last[done + 1 :]
        for j in range(done + 1, len(data) + 1):
            for n in self.lengths:
                if n > j:
                    raise ValueError("the vocabulary does not cover these bytes")
                t = self.ranks.get(data[j - n : j])
                if t is not None and (n == j or self.stay_apart(last[j - n], t)) and (n < j or n == 1 or self.merged(data[:j]) == [t]):
                    last.append(t)
                    break

    def back(self, last: list[int], end: int) -> list[int]:
        out = []
        while end:
            out.append(last[end])
            end -= len(self.bytes[last[end]])
        return out[::-1]

    def word(self, data: bytes) -> list[int]:
        """The ids of one word."""
        t = self.ranks.get(data)
        if t is not None:
            return [t]
        last = [-1]
        self.extend(data, last, 0)
        return self.back(last, len(data))


class TextEncoder:
    """Ids of whole texts: split into words, then encoded word by word, words remembered."""

    def __init__(self, path: str, pattern: str):
        self.words, self.find, self.seen = PrefixEncoder(path), regex.compile(pattern), {}

    def ids(self, text: str | None) -> list[int]:
        """The ids; none for an empty or null text."""
        out: list[int] = []
        for w in self.find.findall(text) if text else ():
            got = self.seen.get(w)
            if got is None:
                if len(self.seen) >= REMEMBERED:
                    self.seen.clear()
                got = self.seen[w] = self.words.word(w.encode())
            out += got
        return out


class EditableText:
    """A text that keeps its encoding while it is appended to and edited.

    A word ends by what is in it and at most two characters after it. So an edit leaves the words
    that end before it, but for the two next to it; words are split anew from there until they
    meet an old boundary behind the edit, and the words after that keep their ids. A word that
    only grew at its end extends its table of prefixes.
    """

    def __init__(self, encoder: TextEncoder, text: str = ""):
        self.encoder, self.text = encoder, ""
        self.words: list[str] = []
        self.tables: list[list[int]] = []
        self.encoded = 0  # words encoded so far, kept or not
        self.edit(0, 0, text)

    def append(self, text: str) -> None:
        self.edit(len(self.text), len(self.text), text)

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace text[start:end]."""
        begins, at = [], 0
        for w in self.words:
            begins.append(at)
            at += len(w)
        keep = 0
        while keep < len(self.words) and begins[keep] + len(self.words[keep]) <= start:
            keep += 1
        keep = max(0, keep - 2)
        at = begins[keep] if keep < len(begins) else sum(map(len, self.words[:keep]))
        self.text = self.text[:start] + new + self.text[end:]
        shift, safe = len(new) - (end - start), start + len(new)
        old = {b + shift: k for k, b in enumerate(begins) if b >= end}
        words, tables, tail = self.words[:keep], self.tables[:keep], len(self.words)
        for m in self.encoder.find.finditer(self.text, at):
            if m.start() >= safe and m.start() in old:
                tail = old[m.start()]
                break
            w, k = m.group().encode(), len(words)
            table = [-1]
            done = 0
            if k < len(self.words) and w.startswith(self.words[k].encode()):
                table, done = list(self.tables[k]), len(self.tables[k]) - 1
            self.encoder.words.extend(w, table, done)
            self.encoded += 1
            words.append(m.group())
            tables.append(table)
        else:
            tail = len(self.words)
        self.words, self.tables = words + self.words[tail:], tables + self.tables[tail:]

    def ids(self) -> list[int]:
        return [i for t in self.tables for i in self.encoder.words.back(t, len(t) - 1)]


_encoders: dict[tuple[str, str], TextEncoder] = {}


def _encoder(path: str, pattern: str) -> TextEncoder:
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = TextEncoder(path, pattern)
    return _encoders[path, pattern]


def encode_documents(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(key, ids) of each row: whole texts, without special tokens, whose strings are ordinary
    text. Null and empty texts have the ids []; blanks are text. Rows with a null key keep it,
    repeated rows stay repeated, and other columns are not read. No shuffle.
    """
    ship(df.sparkSession)
    path, pattern = path or vocabulary_path(), pattern or split_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoder(path, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                flat, ends = array("i"), [0]
                for t in b.column(1).to_pylist():
                    flat.extend(e.ids(t))
                    ends.append(len(flat))
                ids = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.frombuffer(flat, np.int32) if len(flat) else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0), ids], [key, "ids"])

    return df.select(key, text).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, ids array<int>")


def count_tokens(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """(key, also..., n_tokens) of each row, 0 for null and empty texts. No shuffle."""
    ship(df.sparkSession)
    path, pattern = path or vocabulary_path(), pattern or split_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoder(path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([len(e.ids(t)) for t in b.column(len(kept)).to_pylist()], pa.int64())], [*kept, "n_tokens"])

    kept = [key, *also]
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in kept)
    return df.select(*kept, F.col(text)).mapInArrow(run, f"{kinds}, n_tokens bigint")
