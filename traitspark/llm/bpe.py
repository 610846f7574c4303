"""Byte-pair encoding and decoding of whole texts, with tree concatenation for long ones.

A text of up to ``piece`` characters is encoded in its own row. A longer one is
cut into pieces that are encoded in parallel on the cluster. The pieces are the
leaves of a binary tree; going up, the two halves at each join are put together:
the last units of the left half (a cut may have changed them) are encoded again
together with a window of the right half, which grows until the new encoding
reaches a unit boundary that the right half has too. From a common boundary on
both sides agree exactly, because units (the runs that the vocabulary's pattern
splits) are encoded independently and depend only on the text that follows.

Where the vocabulary numbers its tokens in the order of its merges, texts are
encoded by tiktoken with the ranks that this order gives, which is several times
faster and gives the same ids; otherwise by the tokenizers library. Units of
long texts are each encoded once and remembered.

Results for odd input: a null or empty text has no ids and decodes to the empty
text; rows that repeat a ``doc_id``, or have none, are each encoded; an empty
table gives an empty result; special-token strings in a text become their ids,
as the library does by default, and no cut falls inside one.
"""

from __future__ import annotations

import json
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

#: Pattern of the byte-level pre-tokenizer (fixed value of the public vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Characters in a piece of a long text.
PIECE = 1 << 15

#: Rows whose ids are Python objects at a time.
ROWS = 500

#: Different units remembered by a task.
REMEMBERED = 1 << 17


def byte_of_char() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Units and ids of texts by one byte-level vocabulary file."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.special = [a["content"] for a in file["added_tokens"]]
        special = "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True))
        self.split = regex.compile(f"({special})") if special else None
        self.unit = regex.compile(PATTERN)
        self.memory: dict[str, list[int]] = {}
        stand_in = byte_of_char()
        vocabulary = file["model"]["vocab"]
        self.number = vocabulary | {a["content"]: a["id"] for a in file["added_tokens"]}
        self.bytes = {
            i: bytes(stand_in[c] for c in t) if all(c in stand_in for c in t) else t.encode() for t, i in self.number.items()
        }
        merges = [m.split(" ") if isinstance(m, str) else m for m in file["model"]["merges"]]
        ranks = {self.bytes[i]: i for t, i in vocabulary.items() if t not in self.special}
        # tokens of one byte come first, then each merge's own in turn
        self.fast = None
        if all(vocabulary[a + b] == 256 + i for i, (a, b) in enumerate(merges)) and len(ranks) == 256 + len(merges):
            self.fast = tiktoken.Encoding("by ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def tokenizer(self) -> Tokenizer:
        tokenizer = Tokenizer.from_file(self.path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return tokenizer

    def units(self, text: str) -> list[str]:
        """The text cut at the boundaries over which no merge reaches."""
        if self.split is None or not any(s in text for s in self.special):
            return self.unit.findall(text)
        parts = self.split.split(text)
        return list(chain.from_iterable([p] if i % 2 else self.unit.findall(p) for i, p in enumerate(parts)))

    def ids(self, units: list[str]) -> list[int]:
        memory = self.memory
        try:
            return list(chain.from_iterable(map(memory.__getitem__, units)))
        except KeyError:
            if len(memory) > REMEMBERED:
                memory.clear()
            new = [u for u in dict.fromkeys(units) if u not in memory]
            if self.fast is not None:
                for u in new:
                    memory[u] = self.fast.encode_ordinary(u) if u not in self.special else [self.number[u]]
            else:
                for u, e in zip(new, self.tokenizer.encode_batch(new, add_special_tokens=False)):
                    memory[u] = e.ids
            return list(chain.from_iterable(map(memory.__getitem__, units)))

    def whole(self, text: str) -> list[int]:
        """Ids of a text that is not cut."""
        if self.fast is not None:
            if not any(s in text for s in self.special):
                return self.fast.encode_ordinary(text)
            return self.ids(self.units(text))
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")

    def sure(self, units: list[str]) -> int:
        """How many units at the front stay units whatever text follows.

        A unit looks at most one character past its end, and at least two past
        its first (the longest contraction).
        """
        left = 0
        for n in range(len(units), 0, -1):
            size = len(units[n - 1])
            if left >= 1 and left + size >= 3:
                return n
            left += size
        return 0

    def join(self, left: list[str], right: list[str], window: int = 8) -> list[str]:
        """Units of the texts of ``left`` and ``right`` put together.

        ``window`` right units are encoded again at first, then twice as many.
        """
        if not left or not right:
            return left + right
        kept = self.sure(left)
        tail, take = "".join(left[kept:]), window
        while True:
            again = self.units(tail + "".join(right[:take]))
            if take >= len(right):
                return left[:kept] + again
            ends, at = {}, len(tail)
            for i, unit in enumerate(right[:take]):
                at += len(unit)
                ends[at] = i + 1
            at = 0
            for i, unit in enumerate(again[: self.sure(again)]):
                at += len(unit)
                if at in ends:
                    return left[:kept] + again[: i + 1] + right[ends[at] :]
            take *= 2

    def cuts(self, text: str, piece: int) -> list[int]:
        """Places about ``piece`` characters apart, never inside a special token."""
        out, longest = [0], max(map(len, self.special), default=1)
        for at in range(piece, len(text), piece):
            near = text[max(0, at - longest + 1) : at + longest - 1]
            for special in self.special:
                i = near.find(special)
                while i >= 0:
                    begin = max(0, at - longest + 1) + i
                    if begin < at < begin + len(special):
                        at = begin
                    i = near.find(special, i + 1)
            if at > out[-1]:
                out.append(at)
        return out

    def tree(self, leaves: list[list[str]]) -> list[str]:
        """Joins neighbours level by level until one encoding is left."""
        while len(leaves) > 1:
            leaves = [
                self.join(leaves[i], leaves[i + 1]) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)
            ]
        return leaves[0] if leaves else []

    def encode(self, text: str, piece: int = PIECE) -> list[int]:
        """Ids of one text by the tree, in this process."""
        at = [*self.cuts(text, piece), len(text)]
        return self.ids(self.tree([self.units(text[a:b]) for a, b in zip(at, at[1:])]))


def _encode_rows(path: str):
    def emit(batches):
        codec = Codec(path)
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                part = batch.slice(low, ROWS)
                ids = [np.array(codec.whole(t or ""), np.int32) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return emit


def _cut_rows(path: str, piece: int):
    def emit(batches):
        codec = Codec(path)
        for batch in batches:
            for doc_id, key, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "key", "text"))):
                at = [*codec.cuts(text, piece), len(text)]
                for i, (a, b) in enumerate(zip(at, at[1:])):
                    yield pa.RecordBatch.from_pydict(
                        {"doc_id": pa.array([doc_id], pa.int64()), "key": [key], "leaf": pa.array([i], pa.int32()), "text": [text[a:b]]}
                    )

    return emit


def _leaf_rows(path: str):
    """Units of each piece, as their lengths: the text and they say all."""

    def emit(batches):
        codec = Codec(path)
        for batch in batches:
            sizes = [[len(u) for u in codec.units(t)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "key", "leaf", "text")), pa.array(sizes, pa.list_(pa.int32()))],
                ["doc_id", "key", "leaf", "text", "sizes"],
            )

    return emit


def _tree_rows(path: str):
    """Rows come by text and piece; a text's pieces are put together when the last has come."""

    def emit(batches):
        codec = Codec(path)
        current, doc_id, leaves = None, None, []

        def done():
            ids = np.array(codec.ids(codec.tree(leaves)), np.int32)
            return pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), pa.array([ids], pa.list_(pa.int32()))], ["doc_id", "ids"])

        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in ("doc_id", "key", "text", "sizes")}
                if (key := row["key"].as_py()) != current:
                    if leaves:
                        yield done()
                    current, doc_id, leaves = key, row["doc_id"].as_py(), []
                text, at, own = row["text"].as_py(), 0, []
                for n in row["sizes"].as_py():
                    own.append(text[at : at + n])
                    at += n
                leaves.append(own)
        if leaves:
            yield done()

    return emit


def encode(docs: DataFrame, path: str, piece: int = PIECE) -> DataFrame:
    """``doc_id, ids`` for every row: what the tokenizers library gives for the whole text."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    long_text = F.coalesce(F.char_length("text"), F.lit(0)) > piece
    short = texts.where(~long_text).mapInArrow(_encode_rows(path), "doc_id long, ids array<int>")
    # rows that are alike in id and text are told apart by their place in the read
    leaves = (
        texts.where(long_text)
        .withColumn("key", F.monotonically_increasing_id())
        .mapInArrow(_cut_rows(path, piece), "doc_id long, key long, leaf int, text string")
        .repartition("key", "leaf")
        .mapInArrow(_leaf_rows(path), "doc_id long, key long, leaf int, text string, sizes array<int>")
    )
    merged = (
        leaves.repartition("key").sortWithinPartitions("key", "leaf").mapInArrow(_tree_rows(path), "doc_id long, ids array<int>")
    )
    return short.union(merged)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``ids`` of every row back to ``text``; other columns stay."""
    fields = [f for f in encoded.schema.fields if f.name != "text"]

    def emit(batches):
        codec = Codec(path)
        for batch in batches:
            names = [f.name for f in fields]
            for low in range(0, batch.num_rows, ROWS):
                part = batch.slice(low, ROWS)
                texts = [codec.decode(x or []) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(texts, pa.string())], [*names, "text"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return encoded.mapInArrow(emit, f"{schema}, text string")


def digest(encoded: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """Counts and SHA-256 digests of the ids and of the decoded text, and on demand the ids."""
    return decode(encoded, path).select(
        "doc_id",
        *(["ids"] if keep_ids else []),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )
