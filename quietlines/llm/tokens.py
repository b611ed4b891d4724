"""Problem 6: the corpus as token ids of a public byte-level vocabulary.

Method: a streaming transducer with bounded lookahead. Text arrives in blocks. A block
is cut at the last place where the vocabulary's splitting pattern cannot join the two
sides, which one further character decides; the pieces before it are stable. Every
piece goes byte by byte through a state machine over the merge list: the last token of
every prefix is the only token that ends there and is compatible with the last token
before it. Which prefixes a later token may still start from follows from the merge
list: those after which the bytes read so far begin some longer token. A token is
emitted as soon as all of these agree on it; the lookahead is thus never longer than
the longest token, and the working memory does not grow with the text. A piece that
fills more than `RUN` characters enters the machine in parts; results of short pieces
are remembered.

Decoding goes through a byte-to-text state machine that holds back at most the bytes
of one unfinished character.

Defined results: null and empty texts give an empty array; strings that look like
special tokens are ordinary text; repeated rows are encoded each on their own; lone
surrogates, which no table can hold, are read as question marks.
"""

from __future__ import annotations

import base64
import codecs
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the splitting pattern of the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: The same for text of ASCII alone, for the faster matcher.
ASCII = r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]++| ?[0-9]++| ?[^\t-\r A-Za-z0-9]++|[\t-\r ]++\Z|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]"
#: Characters per block, and how many of an unfinished piece are held before the machine gets them.
BLOCK, RUN = 1 << 16, 1 << 13
#: Characters of a piece that is remembered, remembered pieces, and remembered pairs of tokens.
SHORT, PIECES, PAIRS = 32, 1 << 17, 1 << 18

_CUT = regex.compile(r"(?:(?<=\S)(?=\s)|(?<=\p{L})(?=[^\p{L}\s])|(?<=\p{N})(?=[^\p{N}\s])|(?<=[^\s\p{L}\p{N}'])(?=[\p{L}\p{N}]))")
_CLASS = {"letter": regex.compile(r" ?\p{L}+"), "number": regex.compile(r" ?\p{N}+"), "blank": regex.compile(r"\s+"), "other": regex.compile(r" ?[^\s\p{L}\p{N}]+")}


class Pieces(dict):
    """The ids of pieces; a piece that is not there goes through the machine, and stays if it is short."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, text: str) -> list[int]:
        machine = Machine(self.vocabulary)
        ids = machine.feed(text.encode("utf-8", "replace")) + machine.finish()
        if len(text) <= SHORT:
            if len(self) > PIECES:
                self.clear()
            self[text] = ids
        return ids


class Vocabulary:
    """Ranks of a merge list and what the machine derives from them."""

    def __init__(self, ranks_file: bytes, pattern: str = PATTERN):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines()) if a}
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.ascii = re.compile(ASCII) if pattern == PATTERN else self.pattern
        #: Beginnings of longer tokens: what was read since a prefix, as long as a later token may start there.
        self.begun = {b[:n] for b in self.ranks for n in range(1, len(b))}
        #: The most bytes that any token waits for.
        self.lookahead = max(map(len, self.ranks), default=1)
        #: Longest token by its last two bytes; bounds the search for the token that ends at a byte.
        self.longest: dict[bytes, int] = {}
        for b in self.ranks:
            self.longest[b[-2:]] = max(self.longest.get(b[-2:], 1), len(b))
        self._pairs: dict[tuple[int, int], bool] = {}
        self.pieces = Pieces(self)

    def merged(self, data: bytes) -> list[int]:
        """`data` by the merge list: the adjacent parts of the lowest rank join first, until none can."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges leave `left` and `right` apart when they stand together."""
        key = (left, right)
        if key not in self._pairs:
            if len(self._pairs) > PAIRS:
                self._pairs.clear()
            self._pairs[key] = self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return self._pairs[key]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        stream, ids, at = Transducer(self), [], 0
        while len(text) - at > BLOCK:
            ids += stream.feed(text[at : at + BLOCK])
            at += BLOCK
        return ids + stream.finish(text[at:])


class Machine:
    """Encodes one piece given in parts; emits tokens as soon as they are stable."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.data = b""  # from the last emitted boundary on
        self.last: list[tuple[int, int]] = [(-1, -1)]  # per prefix: (token that ends there, where it starts)
        self.before = -1  # the token emitted last

    def feed(self, part: bytes) -> list[int]:
        get, longest, compatible = self.vocabulary.ranks.get, self.vocabulary.longest, self.vocabulary.compatible
        last, seen = self.last, len(self.data)
        data = self.data = self.data + part
        for end in range(seen + 1, len(data) + 1):
            for start in range(max(0, end - longest.get(data[max(0, end - 2) : end], 1)), end):
                token = get(data[start:end])
                if token is None or start and last[start][0] < 0:
                    continue
                left = last[start][0] if start else self.before
                if left < 0 or compatible(left, token):
                    last.append((token, start))
                    break
            else:
                last.append((-1, -1))
        return self._emit()

    def _emit(self) -> list[int]:
        """The tokens on which all prefixes agree that a later token may start from."""
        end, begun = len(self.data), self.vocabulary.begun
        low = max(0, end - self.vocabulary.lookahead + 1)
        open_ends = {p for p in range(low, end) if (p == 0 or self.last[p][0] >= 0) and self.data[p:end] in begun}
        if self.last[end][0] >= 0 or end == 0:
            open_ends.add(end)
        while len(open_ends) > 1:
            highest = max(open_ends)
            open_ends.discard(highest)
            open_ends.add(self.last[highest][1])
        stable = open_ends.pop() if open_ends else 0
        ids = self._chain(stable)
        if stable:
            self.before = ids[-1]
            self.data = self.data[stable:]
            self.last = [(-1, -1)] + [(t, s - stable) if s >= stable else (-1, -1) for t, s in self.last[stable + 1 :]]
        return ids

    def _chain(self, at: int) -> list[int]:
        ids = []
        while at > 0:
            token, at = self.last[at]
            ids.append(token)
        return ids[::-1]

    def finish(self) -> list[int]:
        return self._chain(len(self.data))


class Transducer:
    """Text blocks in, ids out; holds one unfinished stretch of the text."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.pending = ""
        self.run: Machine | None = None
        self.kind = ""

    def _pieces(self, text: str) -> list[int]:
        pattern = self.vocabulary.ascii if text.isascii() else self.vocabulary.pattern
        return list(chain.from_iterable(map(self.vocabulary.pieces.__getitem__, pattern.findall(text))))

    def feed(self, block: str) -> list[int]:
        self.pending += block
        ids = self._continue_run(final=False) if self.run else []
        if self.run:
            return ids
        cut = self._last_cut()
        if cut:
            ids += self._pieces(self.pending[:cut])
            self.pending = self.pending[cut:]
        if len(self.pending) > RUN:
            self.kind = next((k for k, p in _CLASS.items() if p.fullmatch(self.pending)), "")
            if self.kind:
                self.run = Machine(self.vocabulary)
                ids += self._continue_run(final=False)
        return ids

    def _last_cut(self) -> int:
        """The last stable cut; both of its sides have been seen."""
        for width in (16, 256, 4096, len(self.pending)):
            found = [m.start() for m in _CUT.finditer(self.pending, max(0, len(self.pending) - width)) if 0 < m.start() < len(self.pending)]
            if found:
                return found[-1]
        return 0

    def _continue_run(self, final: bool) -> list[int]:
        same = _CLASS[self.kind].match(self.pending)
        end = same.end() if same else 0
        if self.kind != "blank" and self.pending.startswith(" ") and (self.run.data or self.run.before != -1):
            end = 0  # a blank opens the next piece
        ended = final or end < len(self.pending)
        # The last blank before another character belongs to what follows.
        take = end - 1 if self.kind == "blank" and not (final and end == len(self.pending)) else end
        ids = self.run.feed(self.pending[: max(take, 0)].encode("utf-8", "replace"))
        self.pending = self.pending[max(take, 0) :]
        if ended:
            ids += self.run.finish()
            self.run = None
            if not final:
                ids += self.feed("")
        return ids

    def finish(self, block: str = "") -> list[int]:
        """The ids of what is left, given the last block if it was not fed; nothing follows, so all of it is stable."""
        self.pending += block
        ids = self._continue_run(final=True) if self.run else []
        ids += self._pieces(self.pending)
        self.pending = ""
        return ids


class Decoder:
    """Ids in, text out; bytes of an unfinished character wait for the next id."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.state = codecs.getincrementaldecoder("utf-8")(errors="replace")

    def feed(self, ids: list[int]) -> str:
        return "".join(self.state.decode(self.vocabulary.bytes_of[i]) for i in ids)

    def finish(self) -> str:
        return self.state.decode(b"", final=True)


_LOADED: dict[int, Vocabulary] = {}


def loaded(ranks_file: bytes) -> Vocabulary:
    """The vocabulary of this Python worker; built once per process."""
    key = hash(ranks_file)
    if key not in _LOADED:
        _LOADED[key] = Vocabulary(ranks_file)
    return _LOADED[key]


def shared_vocabulary(df: DataFrame, path: str = VOCABULARY):
    """Broadcast of the merge list, a file of under 1 MB whatever the data."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def with_ids(df: DataFrame, key: str, text: str, path: str = VOCABULARY) -> DataFrame:
    """(`key`, `ids`) for every row of `df`; Arrow batches, no shuffle."""
    merges = shared_vocabulary(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = loaded(merges.value)
        for batch in batches:
            ids = [vocabulary.encode(t) for t in batch.column(1).to_pylist()]
            offsets = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(i) for i in ids], out=offsets[1:])
            flat = np.fromiter(chain.from_iterable(ids), np.int32, int(offsets[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], [key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def round_trip(df: DataFrame, key: str, text: str, path: str = VOCABULARY) -> DataFrame:
    """(`key`, `n_tokens`, `same`): whether decoding the ids gives the text again."""
    merges = shared_vocabulary(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = loaded(merges.value)
        for batch in batches:
            counts, same = [], []
            for t in batch.column(1).to_pylist():
                ids, decoder = vocabulary.encode(t), Decoder(vocabulary)
                counts.append(len(ids))
                same.append(decoder.feed(ids) + decoder.finish() == (t or ""))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int32()), pa.array(same, pa.bool_())], [key, "n_tokens", "same"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens int, same boolean")
