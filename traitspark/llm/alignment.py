"""Alignment of two tokenizers' vocabularies, counted over a whole corpus.

Both tokenizers cut the same bytes. Byte offsets where a token of either side
ends cut a text into groups; inside a group every token of side A is linked with
every token of side B. A pair's count is the number of documents that hold it
linked; each document learns how many of its links are the most frequent ones of
their A token, and the sum of its links' counts.

The counting is external. A task encodes texts and turns their links into
pair-document records (pair, document, links). A full buffer becomes a run: the
records are sorted side-major (A id, B id, document), dealt into ``PARTS`` by
the low digits of the A id, packed into blocks and compressed with zstd. The runs
are written to the shared folder, so they outlive lost executors. Then

1. every slice (at most about ``SLICE_RUNS`` runs) of every part is merged by a
   heap over its runs, which gives each pair's documents in the slice;
2. the slices' counts are added, and side-major order gives each A id's highest;
3. every slice reads its runs again and streams the documents' contributions
   back, an array a run and part, which are added to the documents of the run.

A frequent token is in one part of all runs but in as many tasks as there are
slices; only counts of different pairs leave a slice. A task holds compressed
runs of one part and slice, one block a run unpacked.

Results for odd input: null and empty texts, and texts that a side does not give
back byte for byte (a normalising tokenizer, the meta symbol itself), have no
tokens and get zeros and an empty ``groups_sha256``; rows that repeat a
``doc_id``, or have none, are documents of their own; an empty table gives an
empty result; a text is encoded whole, however long, in one task; other columns
than ``doc_id`` and ``text`` are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise, spread
from .bpe import Codec

#: Parts by the low digits of the A id.
PARTS = 16
#: Records of a run; a run is also closed at ``RUN_DOCS`` documents.
RUN_RECORDS = 2_000_000
RUN_DOCS = 100_000
#: Records in a compressed block.
BLOCK_RECORDS = 1 << 16
#: Runs merged by one task.
SLICE_RUNS = 32
#: Bytes of text encoded at once; a longer text is encoded alone.
PIECE_BYTES = 2 << 20
#: Pairs of one group expanded at once.
EXPAND = 1 << 22

ID_BITS = 16

FIELDS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


class Sides:
    """Token ids of both sides and the bytes of each id."""

    def __init__(self, a_path: str, b_path: str):
        self.codec = Codec(a_path)
        self.piece = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes = [self.codec.bytes.get(i, b"") for i in range(max(self.codec.bytes) + 1)]
        self.b_bytes = [self._piece_bytes(i) for i in range(self.piece.get_piece_size())]
        if max(len(self.a_bytes), len(self.b_bytes)) > 1 << ID_BITS:
            raise ValueError(f"ids of more than {ID_BITS} bits")
        self.a_size = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)
        if self.codec.fast is None:
            self.codec.tokenizer.encode_special_tokens = True

    def _piece_bytes(self, i: int) -> bytes:
        piece = self.piece.id_to_piece(i)
        if self.piece.is_byte(i):
            return bytes([int(piece[3:-1], 16)])
        return piece.replace("▁", " ").encode()

    def ids(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of each text with a space before it; none where a side's bytes differ from that."""
        full = [" " + t for t in texts]
        if self.codec.fast is not None:
            a = [self.codec.fast.encode_ordinary(t) for t in full]
        else:
            a = [e.ids for e in self.codec.tokenizer.encode_batch(full, add_special_tokens=False)]
        b = self.piece.encode(texts, num_threads=1)
        for i, text in enumerate(full):
            raw = text.encode()
            sides = ((a[i], self.a_bytes), (b[i], self.b_bytes))
            if not texts[i] or any(b"".join(map(table.__getitem__, ids)) != raw for ids, table in sides):
                a[i], b[i] = [], []
        return a, b


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids in a row, and where each text's begin, with the end."""
    first = np.zeros(len(ids) + 1, np.int64)
    np.cumsum([len(x) for x in ids], out=first[1:])
    flat = np.empty(first[-1], np.int64)
    for at, x in zip(first, ids):
        flat[at : at + len(x)] = x
    return flat, first


def _summed(key: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in ascending order, and the sum of each one's weights."""
    if not len(key):
        return key, weight
    order = np.argsort(key, kind="stable")
    key, weight = key[order], weight[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[first], np.add.reduceat(weight, first)


def _pairs(group_a, a, group_b, b, group_doc) -> tuple[np.ndarray, np.ndarray]:
    """Keys (document, A id, B id) of the linked pairs, and the links of each."""
    groups = len(group_doc)
    if not groups:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    bits = np.uint64(ID_BITS)

    def distinct(group, ids):
        key, n = _summed((group.astype(np.uint64) << bits) | ids.astype(np.uint64), np.ones(len(ids), np.int64))
        return (key >> bits).astype(np.int64), key & np.uint64((1 << ID_BITS) - 1), n

    group_a, a, n_a = distinct(group_a, a)
    group_b, b, n_b = distinct(group_b, b)
    first_b = np.searchsorted(group_b, np.arange(groups + 1))
    partners = np.diff(first_b)[group_a]
    until = np.cumsum(partners)
    keys, links = [], []
    low = 0
    while low < len(a):
        high = max(int(np.searchsorted(until, until[low] - partners[low] + EXPAND, side="right")), low + 1)
        size = partners[low:high]
        left = np.repeat(np.arange(low, high), size)
        right = np.arange(len(left)) - np.repeat(np.cumsum(size) - size, size) + first_b[group_a[left]]
        key = (group_doc[group_a[left]].astype(np.uint64) << np.uint64(2 * ID_BITS)) | (a[left] << bits) | b[right]
        key, n = _summed(key, n_a[left] * n_b[right])
        keys.append(key)
        links.append(n)
        low = high
    return _summed(np.concatenate(keys), np.concatenate(links))


def align(sides: Sides, texts: list[str], words: list[str]) -> tuple[dict[str, list], np.ndarray, np.ndarray]:
    """Digest columns of each text, and the keys and links of its pairs.

    ``words`` are the ids' decimal forms followed by each separator in turn.
    """
    ids_a, ids_b = sides.ids(texts)
    a, first_a = _flat(ids_a)
    b, first_b = _flat(ids_b)
    del ids_a, ids_b
    end_a, end_b = np.cumsum(sides.a_size[a]), np.cumsum(sides.b_size[b])
    cut = np.intersect1d(end_a, end_b, assume_unique=True)
    group_a, group_b = np.searchsorted(cut, end_a), np.searchsorted(cut, end_b)
    in_a, in_b = np.bincount(group_a, minlength=len(cut)), np.bincount(group_b, minlength=len(cut))
    until_a, until_b = np.cumsum(in_a), np.cumsum(in_b)
    first_group = np.searchsorted(until_a, first_a, side="right")
    n_groups = np.diff(first_group)
    group_doc = np.repeat(np.arange(len(texts)), n_groups)
    links = np.bincount(group_doc, weights=in_a * in_b, minlength=len(texts)).astype(np.int64)

    # the text of the groups: A ids, a bar, B ids, a semicolon but at the end
    code = np.empty(len(a) + len(b), np.int64)
    last_a = np.arange(1, len(a) + 1) == until_a[group_a]
    last_b = np.arange(1, len(b) + 1) == until_b[group_b]
    code[np.arange(len(a)) + (until_b - in_b)[group_a]] = a + (last_a.astype(np.int64) << ID_BITS)
    sep_b = np.where(last_b, 2, 0)
    sep_b[first_b[1:][first_b[1:] > first_b[:-1]] - 1] = 3
    code[np.arange(len(b)) + until_a[group_b]] = b + (sep_b.astype(np.int64) << ID_BITS)
    first = first_a + first_b
    digests = []
    for i in range(len(texts)):
        part = code[first[i] : first[i + 1]].tolist()
        digests.append(hashlib.sha256("".join(map(words.__getitem__, part)).encode()).hexdigest() if part else "")
    columns = {
        "n_a": np.diff(first_a),
        "n_b": np.diff(first_b),
        "n_groups": n_groups,
        "n_links": links,
        "groups_sha256": digests,
    }
    return columns, *_pairs(group_a, a, group_b, b, group_doc)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of 32-bit numbers, byte by byte of the same place, compressed."""
    planes = b"".join(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for x in arrays)
    return zstandard.ZstdCompressor(level=1).compress(planes)


def _unpack(body: bytes, *sizes: int) -> list[np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8)
    out, at = [], 0
    for n in sizes:
        out.append(np.ascontiguousarray(planes[at : at + 4 * n].reshape(4, n).T).reshape(-1).view("<u4"))
        at += 4 * n
    return out


class Run:
    """Pair-document records of some documents, until they are sorted and packed."""

    def __init__(self):
        self.docs = self.records = 0
        self.keys: list[np.ndarray] = []
        self.links: list[np.ndarray] = []

    def add(self, keys: np.ndarray, links: np.ndarray, docs: int) -> None:
        doc, pair = (keys >> np.uint64(32)) + np.uint64(self.docs), keys & np.uint64(0xFFFFFFFF)
        self.keys.append((pair << np.uint64(32)) | doc)
        self.links.append(links)
        self.docs += docs
        self.records += len(keys)

    def blocks(self) -> Iterator[tuple[int, int, int, bytes]]:
        """``(part, pairs, records, body)``, side-major inside each part."""
        if not self.records:
            return
        keys, links = np.concatenate(self.keys), np.concatenate(self.links)
        if links.max() >= 1 << 32:
            raise ValueError("a document has more than 2**32 links of one pair")
        part = (keys >> np.uint64(32 + ID_BITS)) % np.uint64(PARTS)
        order = np.lexsort((keys, part))
        keys, links, part = keys[order], links[order], part[order]
        edges = np.searchsorted(part, np.arange(PARTS + 1))
        for p in range(PARTS):
            for low in range(edges[p], edges[p + 1], BLOCK_RECORDS):
                high = min(low + BLOCK_RECORDS, edges[p + 1])
                pair, doc = (keys[low:high] >> np.uint64(32)).astype(np.uint32), keys[low:high].astype(np.uint32)
                first = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
                docs = np.diff(np.concatenate((first, [high - low])))
                steps = np.diff(doc, prepend=np.uint32(0))  # wraps, and unwraps by a running sum
                yield p, len(first), high - low, _pack(pair[first], docs, steps, links[low:high])


def _read(pairs: int, records: int, body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a block, documents of each, and the records' documents and links."""
    pair, docs, steps, links = _unpack(body, pairs, pairs, records, records)
    return pair, docs, np.cumsum(steps, dtype=np.uint32), links


SPILL = f"part int, pairs int, records int, body binary, run long, place int, doc_id long, {FIELDS}"


def _spill_rows(a_path: str, b_path: str):
    """Rows of documents (``part`` is null) and blocks of runs; ``place`` counts both in their run."""
    schema = pa.schema(
        [("part", pa.int32()), ("pairs", pa.int32()), ("records", pa.int32()), ("body", pa.binary()), ("run", pa.int64())]
        + [("place", pa.int32()), ("doc_id", pa.int64())]
        + [(n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")]
        + [("groups_sha256", pa.string())]
    )

    def rows(n: int, **columns):
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def cut(batch) -> Iterator[pa.RecordBatch]:
        sizes = np.array(pa.compute.fill_null(pa.compute.binary_length(batch.column("text")), 0))
        until, low = np.cumsum(sizes), 0
        while low < batch.num_rows:
            high = max(int(np.searchsorted(until, until[low] - sizes[low] + PIECE_BYTES, side="right")), low + 1)
            yield batch.slice(low, high - low)
            low = high

    def emit(batches):
        sides = Sides(a_path, b_path)
        words = [f"{i}{sep}" for sep in (",", "|", ";", "") for i in range(1 << ID_BITS)]
        first = TaskContext.get().partitionId() << 32
        number, run = first, Run()

        def closed():
            for place, (p, pairs, records, body) in enumerate(run.blocks()):
                yield rows(1, part=[p], pairs=[pairs], records=[records], body=[body], run=[number], place=[place])

        for batch in batches:
            for part in cut(batch):
                texts = [t or "" for t in part.column("text").to_pylist()]
                columns, keys, links = align(sides, texts, words)
                place = np.arange(run.docs, run.docs + len(texts))
                yield rows(len(texts), run=np.full(len(texts), number), place=place, doc_id=part.column("doc_id"), **columns)
                run.add(keys, links, len(texts))
                if run.records >= RUN_RECORDS or run.docs >= RUN_DOCS:
                    yield from closed()
                    number, run = number + 1, Run()
        yield from closed()

    return emit


def _count_slice(table: pa.Table) -> pa.Table:
    """Heap merge of a slice's runs: documents of each pair, side-major."""
    table = table.sort_by([("run", "ascending"), ("place", "ascending")])
    runs: dict[int, list[int]] = {}
    for i, run in enumerate(table.column("run").to_pylist()):
        runs.setdefault(run, []).append(i)
    sizes = [table.column(c).to_pylist() for c in ("pairs", "records")]
    bodies = table.column("body")

    def stream(rows: list[int]):
        for i in rows:  # a pair may go on in the next block
            pair, docs, _, _ = _read(sizes[0][i], sizes[1][i], bodies[i].as_py())
            yield from zip(pair.tolist(), docs.tolist())

    pairs, counts, last, total = [], [], None, 0
    for pair, n in heapq.merge(*map(stream, runs.values())):
        if pair != last:
            if last is not None:
                pairs.append(last)
                counts.append(total)
            last, total = pair, 0
        total += n
    if last is not None:
        pairs.append(last)
        counts.append(total)
    first = [table.column(c)[0].as_py() for c in ("part", "slice")]
    return pa.table(
        {
            "part": pa.array([first[0]] * len(pairs), pa.int32()),
            "slice": pa.array([first[1]] * len(pairs), pa.int32()),
            "pair": pa.array(pairs, pa.int64()),
            "n": pa.array(counts, pa.int64()),
        }
    )


def _stream_back(runs: pa.Table, counts: pa.Table) -> pa.Table:
    """Contributions of a part and slice to the documents of each run, an array a run."""
    pair, n, best = (counts.column(c).to_numpy() for c in ("pair", "n", "best"))
    order = np.argsort(pair)
    pair, n, best = pair[order], n[order], best[order].astype(np.int64)
    out: dict[int, list[np.ndarray]] = {}
    for run, pairs, records, body in zip(*(runs.column(c) for c in ("run", "pairs", "records", "body"))):
        own, docs, doc, links = _read(pairs.as_py(), records.as_py(), body.as_py())
        at = np.repeat(np.searchsorted(pair, own), docs)
        sums = out.setdefault(run.as_py(), [np.zeros(0, np.int64), np.zeros(0, np.int64)])
        if len(sums[0]) <= (high := int(doc.max())):
            sums[:] = [np.concatenate((x, np.zeros(high + 1 - len(x), np.int64))) for x in sums]
        np.add.at(sums[0], doc, links * best[at])
        np.add.at(sums[1], doc, links * n[at])
    zip_ = zstandard.ZstdCompressor(level=1)
    body = [zip_.compress(np.ascontiguousarray(np.stack(x).astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()) for x in out.values()]
    return pa.table({"run": pa.array(list(out), pa.int64()), "body": pa.array(body, pa.binary())})


def _add_up(docs: pa.Table, parts: pa.Table) -> pa.Table:
    """The documents of a run with their contributions from all parts."""
    sums = np.zeros((2, docs.num_rows), np.int64)
    for body in parts.column("body"):
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(body.as_py()), np.uint8)
        found = np.ascontiguousarray(raw.reshape(8, -1).T).reshape(-1).view("<i8").reshape(2, -1)
        sums[:, : found.shape[1]] += found
    place = docs.column("place").to_numpy()
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    return pa.table([*(docs.column(n) for n in names), pa.array(sums[0][place]), pa.array(sums[1][place])], [*names, "n_best", "count_sum"])


def spill(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Encodes all texts once and writes document rows and compressed runs."""
    texts = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return materialise(texts.mapInArrow(_spill_rows(a_path, b_path), SPILL), "alignment-runs")


def sliced(spilled: DataFrame) -> DataFrame:
    """Blocks of runs with the ``slice`` each run belongs to."""
    blocks = spilled.where("part is not null").select("part", "pairs", "records", "body", "run", "place")
    runs = blocks.agg(F.count_distinct("run")).first()[0]
    slices = max(1, -(-runs // SLICE_RUNS))
    return blocks.withColumn("slice", F.pmod(F.xxhash64("run"), F.lit(slices)).cast("int"))


def slice_counts(blocks: DataFrame) -> DataFrame:
    """Documents of each pair in every part and slice."""
    counted = blocks.groupBy("part", "slice").applyInArrow(_count_slice, "part int, slice int, pair long, n long")
    return materialise(counted, "alignment-counts")


def pair_counts(counted: DataFrame) -> DataFrame:
    """``part, pair, a, b, n, best``: documents of each pair in the corpus, and whether no pair of its A id has more."""
    totals = counted.groupBy("part", "pair").agg(F.sum("n").alias("n"))
    totals = totals.select("part", "pair", "n", F.shiftright("pair", ID_BITS).alias("a"), F.col("pair").bitwiseAND((1 << ID_BITS) - 1).alias("b"))
    # an A id has at most as many pairs as side B has ids
    return totals.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("a")))


def align_corpus(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every document."""
    spilled = spill(docs, a_path, b_path)
    blocks = sliced(spilled)
    counted = slice_counts(blocks)
    priced = counted.select("part", "slice", "pair").join(pair_counts(counted).select("part", "pair", "n", "best"), ["part", "pair"])
    back = (
        blocks.groupBy("part", "slice")
        .cogroup(priced.groupBy("part", "slice"))
        .applyInArrow(_stream_back, "run long, body binary")
    )
    rows = spilled.where("part is null").select("run", "place", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    out = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    return (
        rows.groupBy("run")
        .cogroup(back.groupBy("run"))
        .applyInArrow(_add_up, out)
        .select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    )
