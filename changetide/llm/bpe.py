"""Byte-level BPE by longest matches and backtracking.

A piece of text is first matched against an Aho-Corasick automaton of all tokens (bytes stand as
Latin-1 characters). From the longest token at each position the encoder goes on as long as
adjacent tokens are compatible, and steps back to shorter tokens where they are not. Two tokens are
compatible if merging their joined bytes by rank gives just these two again; a sequence of
compatible tokens is the one that rank-ordered merging makes. Each position is given up once at
most, so a piece takes time in proportion to its length. Compatibility and whole pieces are
memoised per worker, in tables of bounded size.

Null text counts as empty: no tokens, digests of nothing. Repeated rows give repeated rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changetide.llm.words import slices

MAX_RANKS_BYTES = 64 << 20
#: Entries of a worker's tables, at about 250 and 90 bytes each, so that both stay near 64 MB.
PIECES_KEPT = 150_000
PAIRS_KEPT = 300_000
LONGEST_KEPT = 48

# The white space of the Unicode property of that name.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def _ranges(property_name: str, top: int) -> str:
    """The code points of a Unicode property as the inside of a character class."""
    every = "".join(map(chr, (c for c in range(top) if not 0xD800 <= c < 0xE000)))
    runs = regex.findall(rf"\p{{{property_name}}}+", every)
    return "".join(f"\\U{ord(r[0]):08x}-\\U{ord(r[-1]):08x}" for r in runs)


def _written_out(pattern: str, top: int):
    """The pattern for the standard library's matcher, for texts of code points below top."""
    inside = {r"\s": WHITE, r"\p{L}": _ranges("L", top), r"\p{N}": _ranges("N", top)}

    def class_of(match):
        body = match[0]
        if body.startswith("["):
            for name, chars in inside.items():
                body = body.replace(name, chars)
            return body
        return f"[^{WHITE}]" if body == r"\S" else f"[{inside[body]}]"

    return re.compile(re.sub(r"\[[^\]]*\]|\\p\{\w\}|\\s|\\S", class_of, pattern)).findall


@lru_cache(4)
def splitter(pattern: str):
    """All matches of a pattern of property classes. The standard matcher is fast where its classes fit
    into its tables, which hold the basic plane; it is slow beyond."""
    basic, every = _written_out(pattern, 0x10000), _written_out(pattern, 0x110000)
    beyond = re.compile("[\U00010000-\U0010ffff]").search
    return lambda text: every(text) if beyond(text) else basic(text)


def merged(data: bytes, ranks: dict[bytes, int], below: int) -> list[bytes]:
    """Merge neighbours of the lowest rank first, leftmost first, with ranks under a limit."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
        if rank >= below:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Encoder:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        top = max(ranks.values(), default=0) + 1
        self.bytes_of = [b""] * top
        self.left: list = [None] * top
        self.right: list = [None] * top
        self.shorter: list = [None] * top
        self.automaton = ahocorasick.Automaton()
        reached = set()
        for data, rank in ranks.items():
            self.bytes_of[rank] = data
            if len(data) == 1:
                reached.add(data)
                continue
            halves = merged(data, ranks, rank)
            if len(halves) == 2:  # else merging never makes this token
                reached.add(data)
                self.left[rank], self.right[rank] = (ranks[h] for h in halves)
        for data in reached:
            rank = ranks[data]
            self.automaton.add_word(data.decode("latin-1"), rank)
            self.shorter[rank] = next((ranks[p] for n in range(len(data) - 1, 0, -1) if (p := data[:n]) in reached), None)
        self.automaton.make_automaton()
        self.size = [len(b) for b in self.bytes_of]
        self.decimal = [str(i) for i in range(top)]
        self.shift = top.bit_length()
        self.pairs: dict[int, bool] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}

    def _merge_apart(self, a: int, b: int) -> bool:
        """Do the tokens stay apart? Their merges are undone, latest first, and the symbols that meet
        at the border are looked up: they must not merge before one of them is merged elsewhere."""
        left, right, bytes_of, ranks = self.left, self.right, self.bytes_of, self.ranks
        until = len(bytes_of)
        while True:
            border = ranks.get(bytes_of[a] + bytes_of[b])
            if border is not None and border < until:
                return False
            if left[a] is not None and (a > b or left[b] is None):
                until, a = a, right[a]
            elif left[b] is not None:
                until, b = b + 1, left[b]  # of equal merges the left one comes first
            else:
                return True

    def compatible(self, a: int, b: int) -> bool:
        key = a << self.shift | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS_KEPT:
                self.pairs.clear()
            known = self.pairs[key] = self._merge_apart(a, b)
        return known

    def piece(self, data: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(data)
        if whole is not None:
            return (whole,)
        size, shorter, compatible = self.size, self.shorter, self.compatible
        total = len(data)
        longest: list = [None] * total
        for end, token in self.automaton.iter(data.decode("latin-1")):
            longest[end + 1 - size[token]] = token  # ends grow: the last one is the longest
        given_up = bytearray(total + 1)
        ids: list[int] = []
        at, token = 0, longest[0]
        while at < total:
            before = ids[-1] if ids else None
            while token is not None:
                end = at + size[token]
                if not given_up[end] and (before is None or compatible(before, token)):
                    break
                token = shorter[token]
            if token is not None:
                ids.append(token)
                at = end
                token = longest[at] if at < total else None
            else:
                if not ids:
                    raise ValueError("the ranks lack single bytes of this text")
                given_up[at] = 1
                at -= size[before]
                token = shorter[ids.pop()]
        return tuple(ids)

    def encode(self, parts: list[str]) -> list[int]:
        ids: list[int] = []
        get = self.pieces.get
        for part in parts:
            found = get(part)
            if found is None:
                found = self.piece(part.encode())
                if len(part) <= LONGEST_KEPT:
                    if len(self.pieces) >= PIECES_KEPT:
                        self.pieces.clear()
                    self.pieces[part] = found
            ids += found
        return ids

    def forget(self) -> None:
        """Give the memory of the tables back; they fill again as texts are encoded."""
        self.pieces.clear()
        self.pairs.clear()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(2)
def encoder(rank_file: bytes) -> Encoder:
    lines = (line.split() for line in rank_file.splitlines() if line)
    return Encoder({base64.b64decode(data): int(rank) for data, rank in lines})


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as file:
        data = file.read(MAX_RANKS_BYTES + 1)
    if len(data) > MAX_RANKS_BYTES:
        raise ValueError(f"{path} is larger than {MAX_RANKS_BYTES} bytes")
    return data


def _over_texts(docs: DataFrame, ranks_path: str, pattern: str, schema: str, make, id_col: str, text_col: str) -> DataFrame:
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches):
        own, split = encoder(ranks.value), splitter(pattern)
        for batch in slices(batches):
            rows = [make(own, own.encode(split(text or ""))) for text in batch.column(1).to_pylist()]
            columns = list(zip(*rows)) if rows else [[]] * len(names)
            arrays = [pa.array(c, t) for c, t in zip(columns, types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=[id_col, *names])
        own.forget()  # a worker outlives its tasks

    frame = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}
    types = [kinds[f.split()[1]] for f in schema.split(", ")]
    key = docs.schema[id_col].dataType.simpleString()
    return frame.mapInArrow(run, f"`{id_col}` {key}, {schema}")


def tokens(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of every text: (id, ids array<int>)."""
    return _over_texts(docs, ranks_path, pattern, "ids array<int>", lambda own, ids: (ids,), id_col, text_col)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, decode the ids again, and return counts and digests of both."""

    def digests(own: Encoder, ids: list[int]):
        listed = ",".join(map(own.decimal.__getitem__, ids)).encode()
        return len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()

    schema = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return _over_texts(docs, ranks_path, pattern, schema, digests, id_col, text_col)
