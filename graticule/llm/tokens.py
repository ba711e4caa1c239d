"""Encoding of a corpus with a public byte-level BPE tokenizer (problem 8).

A text is cut where a space stands before a character that is no space: no piece of the tokenizer's pattern crosses such
a place, so every cut part is encoded on its own, and a part that is still open at the end of a chunk is the only thing
that a stream holds back. Parts are remembered; what isn't known is cut by the tokenizer's pattern into pieces, and each
piece goes through a streaming transducer for the merge list:

* of every prefix the last token is known (the encoding of a prefix is that of a shorter prefix and one more token, and
  two tokens may stand side by side exactly if encoding their bytes together gives the two);
* a later token can only begin at a place from which the bytes read so far are the beginning of some token. This is the
  lookahead that the merge list needs; it is computed from the list as the set of the tokens' proper beginnings;
* tokens on which the chains of all such places agree are stable and are emitted; only what follows is kept, so the
  memory doesn't grow with the text. States and steps are kept in a table that is emptied when it is full.

Decoding runs the ids through a table of bytes and an incremental state machine from UTF-8 bytes to text.

Defined cases: null and empty texts give an empty list; special tokens' strings are ordinary text; further columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pattern of the byte-level tokenizers.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Entries of a process's tables of parts and of steps.
PARTS, STEPS = 400_000, 400_000


def vocabulary_file(name: str = VOCABULARY, folder: str | None = None) -> bytes:
    with open(os.path.join(folder or os.environ.get("GRATICULE_TOKENIZERS", "/opt/tokenizers"), name), "rb") as f:
        return f.read()


class Transducer:
    """The merge list as a machine that reads bytes and emits token ids as soon as they are stable."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.begins = {b[:i] for b in ranks for i in range(1, len(b))}
        self.lookahead = max(map(len, ranks), default=1) - 1
        self.side: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        # a state: the token before the kept bytes (-1 at the start), the kept bytes, and the last token of each place in them
        self.states: list[tuple[int, bytes, tuple[int, ...]]] = [(-1, b"", ())]
        self.number = {self.states[0]: 0}
        self.steps: dict[int, tuple[int, tuple[int, ...]]] = {}

    def merged(self, data: bytes) -> list[bytes]:
        """The merge list applied to a few bytes."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def beside(self, a: int, b: int) -> bool:
        known = self.side.get((a, b))
        if known is None:
            x, y = self.bytes_of[a], self.bytes_of[b]
            if len(self.side) > STEPS:
                self.side.clear()
            known = self.side[a, b] = self.merged(x + y) == [x, y]
        return known

    def step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        before, kept, last = self.states[state]
        kept += bytes((byte,))
        n = len(kept)
        for start in range(n):
            token = self.ranks.get(kept[start:])
            if token is None:
                continue
            left = last[start - 1] if start else before
            if left < 0 or self.beside(left, token):
                break
        last += (token,)
        # places where a later token may begin, and the chains of tokens that lead there
        chains = [self._chain(kept, last, k) for k in range(n + 1) if k == n or kept[k:] in self.begins]
        stable = 0
        while all(len(c) > stable for c in chains) and len({c[stable] for c in chains}) == 1:
            stable += 1
        emitted = tuple(chains[0][:stable])
        cut = sum(len(self.bytes_of[t]) for t in emitted)
        new = (emitted[-1] if emitted else before, kept[cut:], last[cut:])
        to = self.number.get(new)
        if to is None:
            to = self.number[new] = len(self.states)
            self.states.append(new)
        return to, emitted

    def _chain(self, kept: bytes, last: tuple[int, ...], k: int) -> list[int]:
        chain = []
        while k:
            chain.append(last[k - 1])
            k -= len(self.bytes_of[last[k - 1]])
        return chain[::-1]

    def feed(self, data: bytes, state: int = 0) -> tuple[list[int], int]:
        """The stable tokens after these bytes, and the state from which the next bytes go on."""
        out: list[int] = []
        steps = self.steps
        for byte in data:
            key = state << 8 | byte
            found = steps.get(key)
            if found is None:
                if len(self.steps) > STEPS:
                    kept = self.states[state]
                    self.reset()
                    steps = self.steps
                    state = self.number.setdefault(kept, len(self.states))
                    if state == len(self.states):
                        self.states.append(kept)
                    key = state << 8 | byte
                found = steps[key] = self.step(state, byte)
            state = found[0]
            if found[1]:
                out += found[1]
        return out, state

    def finish(self, state: int) -> list[int]:
        _, kept, last = self.states[state]
        return self._chain(kept, last, len(kept))

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        out, state = self.feed(piece)
        return out + self.finish(state)


class Encoder:
    """Texts to ids; ``encode`` for a text at hand, ``stream`` for one that comes in chunks."""

    def __init__(self, vocabulary: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        self.machine = Transducer(ranks)
        self.pattern = regex.compile(PATTERN)
        self.pieces: dict[str, bytes] = {}
        self.inner: dict[str, bytes] = {}  # parts after a space, without it

    def _part(self, text: str) -> bytes:
        out = []
        for piece in self.pattern.findall(text):
            ids = self.pieces.get(piece)
            if ids is None:
                if len(self.pieces) > PARTS:
                    self.pieces.clear()
                ids = np.array(self.machine.encode(piece.encode()), np.int32).tobytes()
                if len(piece) <= 64:
                    self.pieces[piece] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """The ids as int32 bytes."""
        words = text.split(" ")
        known = self.inner
        out = [self._part(words[0])] if words[0] and not words[0].isspace() else None
        if out is None:  # starts with white space
            return self._slow(words)
        for w in words[1:]:
            ids = known.get(w)
            if ids is None:
                if not w or w[0].isspace():
                    return self._slow(words)
                ids = self._part(" " + w)
                if len(w) <= 64:
                    if len(known) > PARTS:
                        known.clear()
                    known[w] = ids
            out.append(ids)
        return b"".join(out)

    def _slow(self, words: list[str]) -> bytes:
        """As ``encode``, where some space stands before another white space or at the end: it belongs to the part before."""
        parts: list[list[str]] = [[words[0]]]
        for w in words[1:]:
            if w and not w[0].isspace():
                parts.append([w])
            else:
                parts[-1].append(w)
        out = [self._part(" ".join(parts[0]))]
        for p in parts[1:]:
            w = " ".join(p)
            ids = self.inner.get(w)
            if ids is None:
                ids = self._part(" " + w)
                if len(w) <= 64:
                    if len(self.inner) > PARTS:
                        self.inner.clear()
                    self.inner[w] = ids
            out.append(ids)
        return b"".join(out)

    def stream(self, chunks: Iterable[str]) -> Iterator[np.ndarray]:
        """Ids of a text in chunks; of each chunk only the part after its last certain cut is held back."""
        held = ""
        cut = regex.compile(r" (?=\S)")
        for chunk in chunks:
            held += chunk
            places = [m.start() for m in cut.finditer(held)]
            if places:
                yield np.frombuffer(self.encode(held[: places[-1]]), np.int32)
                held = held[places[-1] :]
        yield np.frombuffer(self.encode(held), np.int32) if held else np.zeros(0, np.int32)


class Decoder:
    """Ids to text, in steps: bytes that don't make up a character yet wait for the next ids."""

    def __init__(self, vocabulary: bytes):
        self.bytes_of = {int(b): base64.b64decode(a) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        self.waiting = b""

    def feed(self, ids: Iterable[int], last: bool = False) -> str:
        data = self.waiting + b"".join(self.bytes_of[i] for i in ids)
        end = len(data)
        if not last:
            # states of the machine: 1 to 3 continuation bytes are still due after the last leading byte
            for back in range(1, min(4, end + 1)):
                byte = data[end - back]
                if byte & 0xC0 != 0x80:
                    due = 4 if byte >= 0xF0 else 3 if byte >= 0xE0 else 2 if byte >= 0xC0 else 1
                    end -= back if due > back else 0
                    break
        self.waiting = data[end:]
        return data[:end].decode("utf-8", "replace")


@lru_cache(2)
def _encoder(vocabulary: bytes) -> Encoder:
    return Encoder(vocabulary)


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", out: str = "ids", tokenizer: str = VOCABULARY, folder: str | None = None, sizes_only: bool = False) -> DataFrame:
    """(key, ids) of every row, or (key, number of ids); a map over the rows without a shuffle.

    The vocabulary, under 1 MB, is read once by the driver and broadcast, so that executors need no such file.
    """
    shared = df.sparkSession.sparkContext.broadcast(vocabulary_file(tokenizer, folder))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for batch in batches:
            texts = batch.column(1)
            for at in range(0, len(texts), 1000):  # keeps what a batch holds small
                made = [encoder.encode(t) if t else b"" for t in texts.slice(at, 1000).to_pylist()]
                ends = np.cumsum([0, *[len(m) // 4 for m in made]])
                if sizes_only:
                    col = pa.array(np.diff(ends), pa.int64())
                else:
                    col = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(np.frombuffer(b"".join(made), np.int32))).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 1000), col], names=[key, out])

    kind = dict(df.dtypes)[key]
    return df.select(key, text).mapInArrow(rows, f"`{key}` {kind}, `{out}` " + ("bigint" if sizes_only else "array<int>"))


def decode(df: DataFrame, key: str = "doc_id", ids: str = "ids", out: str = "text", tokenizer: str = VOCABULARY, folder: str | None = None) -> DataFrame:
    """(key, text) of rows of ids."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary_file(tokenizer, folder))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for batch in batches:
            texts = [None if x is None else decoder.feed(x, last=True) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, out])

    return df.select(key, ids).mapInArrow(rows, f"`{key}` {dict(df.dtypes)[key]}, `{out}` string")
