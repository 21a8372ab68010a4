"""Byte-pair merging of a public byte-level vocabulary: token counts without ids, and ids through the tokenizers library.

Both walk a text by its single spaces. In the byte-level split a space before a character that is no white space always
begins a new piece, so what stands between two such spaces can be encoded alone and kept in a bounded cache. Texts with
other runs of white space take the plain way.
"""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass
from functools import cached_property

import regex

#: The split of byte-level BPE with 50k entries. Fixed value: it must equal the library's.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
CACHE = 300_000  #: entries that a worker keeps; a full cache starts anew
LONGEST_KEPT = 64  #: characters of a piece that is kept


class Irregular(Exception):
    """The text has white space that the walk by single spaces can't take."""


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte: itself if printable, else the next free one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}


@dataclass
class Merges:
    """ranks: left symbol -> right symbol -> (rank, merged symbol), by number; single: number of each byte's symbol."""

    single: list[int]
    ranks: dict[int, dict[int, tuple[int, int]]]
    special: tuple[str, ...]

    @classmethod
    def read(cls, path: str) -> Merges:
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        vocab, ranks = told["model"]["vocab"], {}
        for rank, pair in enumerate(told["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            ranks.setdefault(vocab[left], {})[vocab[right]] = (rank, vocab[left + right])
        symbols = byte_symbols()
        return cls([vocab[symbols[b]] for b in range(256)], ranks, tuple(t["content"] for t in told["added_tokens"]))


def merged_length(data: bytes, merges: Merges) -> int:
    """Symbols that are left of `data` when no adjacent pair has a rank: a heap gives the lowest rank, leftmost first; links give neighbours."""
    symbol = [merges.single[b] for b in data]
    n = left = len(symbol)
    if n < 2:
        return n
    ranks, nothing = merges.ranks, {}
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []
    for at in range(n - 1):
        if found := ranks.get(symbol[at], nothing).get(symbol[at + 1]):
            heap.append((found[0], at, symbol[at], symbol[at + 1], found[1]))
    heapq.heapify(heap)
    while heap:
        _, at, a, b, made = heapq.heappop(heap)
        beside = after[at]
        if symbol[at] != a or beside >= n or symbol[beside] != b:
            continue  # one of the two has gone into another symbol meanwhile
        symbol[at], symbol[beside] = made, -1
        after[at] = behind = after[beside]
        left -= 1
        if behind < n:
            before[behind] = at
            if found := ranks.get(made, nothing).get(symbol[behind]):
                heapq.heappush(heap, (found[0], at, made, symbol[behind], found[1]))
        if (ahead := before[at]) >= 0 and (found := ranks.get(symbol[ahead], nothing).get(made)):
            heapq.heappush(heap, (found[0], ahead, symbol[ahead], made, found[1]))
    return left


def between_spaces(chunk: str) -> str:
    """The piece of text that `chunk`, found between single spaces, stands for."""
    if not chunk or chunk[0].isspace() or not chunk[0].isprintable():
        raise Irregular
    return " " + chunk


class Counter(dict):
    """chunk -> its number of tokens."""

    def __init__(self, merges: Merges):
        super().__init__()
        self.merges, self.pieces = merges, {}
        self.special = regex.compile("|".join(map(regex.escape, merges.special)) or r"(?!)")

    def of_piece(self, piece: str) -> int:
        found = self.pieces.get(piece)
        if found is None:
            found = merged_length(piece.encode("utf-8", "replace"), self.merges)
            if len(piece) <= LONGEST_KEPT:
                if len(self.pieces) >= CACHE:
                    self.pieces.clear()
                self.pieces[piece] = found
        return found

    def plain(self, text: str) -> int:
        return sum(map(self.of_piece, SPLIT.findall(text)))

    def __missing__(self, chunk: str) -> int:
        found = self.plain(between_spaces(chunk))
        if len(chunk) <= LONGEST_KEPT:
            if len(self) >= CACHE:
                self.clear()
            self[chunk] = found
        return found

    def segment(self, text: str) -> int:
        first, *chunks = text.split(" ")
        try:
            return self.plain(first) + sum(map(self.__getitem__, chunks))
        except Irregular:
            return self.plain(text)

    def count(self, text: str | None) -> int:
        """Tokens of the whole text; a special string counts as one token, as the library's default has it."""
        if not text:
            return 0
        if not any(s in text for s in self.merges.special):
            return self.segment(text)
        found = self.special.findall(text)
        return len(found) + sum(map(self.segment, self.special.split(text)))


class Ids:
    """Ids as the tokenizers library gives them for its file, without added special tokens.

    tiktoken gets the file's vocabulary as ranks and encodes ordinary text, which it does four times as fast; texts that
    hold a special string go to the tokenizers library itself. Tests hold both against each other.
    """

    def __init__(self, definition: str):
        import tiktoken

        told = json.loads(definition)
        byte = {symbol: b for b, symbol in byte_symbols().items()}
        self.special = tuple(t["content"] for t in told["added_tokens"])
        ranks = {bytes(map(byte.__getitem__, k)): v for k, v in told["model"]["vocab"].items() if k not in self.special}
        self.fast = tiktoken.Encoding("from_file", pat_str=SPLIT.pattern, mergeable_ranks=ranks, special_tokens={})
        self.definition = definition

    @cached_property
    def library(self):
        """Made when a text first needs it: it takes tens of MB of a worker."""
        from tokenizers import Tokenizer

        made = Tokenizer.from_str(self.definition)
        made.no_truncation()
        made.no_padding()
        return made

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if any(s in text for s in self.special):
            return self.library.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)
