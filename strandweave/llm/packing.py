"""Operator 8: packing of token sequences, best fit decreasing.

Documents are tokenised with a public byte-level BPE, ended with one separator id and cut: full
windows first, one remainder last. Remainders go, longest first, into the open window with the
least sufficient room, which a segment tree over remaining capacities finds in O(log window).

Texts are tokenised once, in the tasks that scan them; what leaves a task is a few numbers per
piece, which are written. Only remainders, without texts or ids, are shuffled: they are dealt
into blocks of about BLOCK rows of all scan splits, each sorted by length and streamed through
the packer. Padding thus does not depend on how many files or splits the documents came in.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import short_batches, table, written

WINDOW = 1024
#: Id that ends every document.
SEPARATOR = 0
#: Remainders that are packed together, about.
BLOCK = 50_000
#: sequence_id of a shared window is block * 2**32 + number within the block; of a window that one
#: document fills, 2**62 + partition * 2**40 + number within the partition.
BLOCK_SHIFT, FULL, PARTITION_SHIFT = 32, 1 << 62, 40

SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


class CapacityTree:
    """Segment tree over remaining capacities 0..window: how many open windows have each.

    ``tightest(need)`` returns the least capacity >= need that some open window has, or -1.
    """

    def __init__(self, window: int):
        self.base = 1 << window.bit_length()
        self.count = [0] * (2 * self.base)

    def add(self, capacity: int, by: int) -> None:
        node = capacity + self.base
        while node:
            self.count[node] += by
            node >>= 1

    def tightest(self, need: int) -> int:
        node = need + self.base
        if self.count[node]:
            return need
        while node > 1:
            if not node & 1 and self.count[node + 1]:
                node += 1
                while node < self.base:
                    node = 2 * node if self.count[2 * node] else 2 * node + 1
                return node - self.base
            node >>= 1
        return -1


class BestFit:
    """Places lengths, which come in decreasing order, one by one: ``place(n)`` gives (sequence,
    offset) for 1 <= n <= window. Of windows of equal room the latest one opened is taken. Only
    windows with room are remembered."""

    def __init__(self, window: int = WINDOW):
        self.window, self.opened = window, 0
        self.tree, self.free = CapacityTree(window), [[] for _ in range(window + 1)]

    def place(self, n: int) -> tuple[int, int]:
        room = self.tree.tightest(n)
        if room < 0:
            seq, room = self.opened, self.window
            self.opened += 1
        else:
            seq = self.free[room].pop()
            self.tree.add(room, -1)
        if room > n:
            self.free[room - n].append(seq)
            self.tree.add(room - n, 1)
        return seq, self.window - room


def best_fit_decreasing(lengths: list[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """(sequence, offset) for each length, 1 <= length <= window. Ties: the earlier item first."""
    packer, out = BestFit(window), [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        out[i] = packer.place(lengths[i])
    return out


@lru_cache(maxsize=2)
def encoder(name: str):
    """``text -> ids`` of the vocabulary file ``name`` of /opt/tokenizers, as the `tokenizers`
    library gives them: the string of a special token inside a text is that token. A ``.json`` BPE
    whose special tokens take no white space along has a rank file of the same ids, which is
    read when it is there, since its library is several times faster."""
    import os

    import public_tokenizers

    path = public_tokenizers.path(name)
    special, ranks = {}, path
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            added = json.load(f)["added_tokens"]
        special = {t["content"]: t["id"] for t in added}
        ranks = path[: -len(".json")] + ".tiktoken"
        if any(t[flag] for t in added for flag in ("single_word", "lstrip", "rstrip", "normalized")) or not os.path.exists(ranks):
            from tokenizers import Tokenizer

            whole = Tokenizer.from_file(path)
            return lambda text: whole.encode(text, add_special_tokens=False).ids
    import tiktoken

    with open(ranks, "rb") as f:
        table_ = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    bpe = tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table_, special_tokens=special)
    return lambda text: bpe.encode(text, allowed_special="all", disallowed_special=())


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    target = pa.schema([pa.field(n.split()[0], pa.int64()) for n in SCHEMA.split(", ")])
    cols = list(zip(*rows, strict=True)) or [[]] * len(target)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=target)


def pieces(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", window: int = WINDOW) -> DataFrame:
    """The pieces of every document: full windows with their sequence_id and offset 0, remainders
    with nulls there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        sequence = FULL + (TaskContext.get().partitionId() << PARTITION_SHIFT)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                ids = encode(text.as_py() or "")
                ids.append(SEPARATOR)
                data, n, key = np.array(ids, "<u4").tobytes(), len(ids), doc_id.as_py()
                cut = n - n % window
                for start in range(0, cut, window):
                    rows.append((key, start, window, zlib.crc32(data[4 * start : 4 * (start + window)]), n, sequence, 0))
                    sequence += 1
                if cut < n:
                    rows.append((key, cut, n - cut, zlib.crc32(data[4 * cut :]), n, None, None))
            yield _batch(rows)

    short_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """One row per piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset. A sequence holds ``window`` ids at most and is filled gaplessly from offset 0.

    ``block`` remainders, about, share windows: a larger block pads less and takes longer in one
    task, whose memory is that of its windows with room. Which remainders come together is a hash
    of their rows' places, so that repeated rows do not crowd into one block.

    Nulls: a null text is empty, so the document is its separator alone; a null doc_id stays
    null. Repeated rows are packed as often as they occur. Very long texts are tokenised whole
    and become full windows. Ties in length go by doc_id, start and checksum. An empty table gives
    no rows. Other columns are not read.
    """
    cut = written(pieces(docs, tokenizer, window))
    rest = cut.where("offset is null")
    blocks = max(1, -(-rest.count() // block))
    number = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).alias("block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, packer = None, None
        for batch in batches:
            rows = []
            for *piece, own in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if own != at:
                    at, packer = own, BestFit(window)
                seq, offset = packer.place(piece[2])
                rows.append((*piece, (own << BLOCK_SHIFT) + seq, offset))
            yield _batch(rows)

    dealt = rest.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", number).repartition(blocks, "block")
    dealt = dealt.sortWithinPartitions("block", F.desc("length"), "doc_id", "start", "ids_crc32")
    return cut.where("offset is not null").unionByName(dealt.mapInArrow(run, SCHEMA))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 ids; see :func:`pack`."""
    return pack(table(spark, sf_dir, "documents"))
