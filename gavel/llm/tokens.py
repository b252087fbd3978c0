"""Token counts: pieces are counted once per distinct pre-token and joined to the documents' pre-token frequencies.

The vocabulary's pre-tokenizer never joins what white space divides, and drops white space: what stands between white space is a
pre-token here.  Whole texts are cut once; each block of documents becomes frequencies: for each of its distinct pre-tokens, the
documents that hold it and how often.  These are dealt by a hash of the pre-token into buckets.  There each distinct pre-token is
encoded once by the public library, only to count its pieces, and the counts are joined to the frequencies by the pre-token itself;
frequency times pieces, summed per document, goes back to the document's block.  Ids are never kept.

Skew: a pre-token is one entry for each block and not for each document.  Where it stands in many documents of a block, its entry
goes to a bucket of the block's choice, so that the most common pre-tokens are spread over all buckets (and encoded in each).
Nothing is written but the two exchanges, which executors can compute again.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHasher, column, mix, table

LIMIT = 2048
#: A block ends at so many documents or characters; a longer text is a block of its own, cut in stretches.
BLOCK_DOCS, BLOCK_CHARS, STRETCH = 1 << 14, 1 << 24, 1 << 20
#: Buckets: as many as shuffle partitions, at most this many.  A pre-token of a larger share of a block's documents is common.
BUCKETS, COMMON_SHARE, COMMON_DOCS = 1 << 14, 64, 32
#: Pre-tokens, and their characters, that a task remembers the pieces of; beyond, it forgets all and counts anew.
REMEMBERED, REMEMBERED_CHARS = 1 << 20, 1 << 25
#: Unicode's White_Space, by which the vocabulary's normalizer and pattern divide; Python's str.split() takes four more.
WHITE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
ODD = re.compile("[\x1c-\x1f]")


def pre_tokens(text: str) -> list[str]:
    return [x for x in WHITE.split(text) if x] if ODD.search(text) else text.split()


def stretches(text: str, length: int) -> Iterator[str]:
    """The text in parts that end at white space, of about ``length`` characters each."""
    at = 0
    while len(text) - at > length:
        gap = WHITE.search(text, at + length)
        if not gap:
            break
        yield text[at : gap.start()]
        at = gap.end()
    yield text[at:] if at else text


def slim(x: np.ndarray) -> bytes:
    """Whole numbers from 0 on in as few bytes each as the largest needs."""
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0)).tobytes()


def wide(data: bytes, n: int) -> np.ndarray:
    """``n`` numbers written by ``slim``."""
    return np.frombuffer(data, f"u{len(data) // n}") if n else np.empty(0, np.uint8)


class Codes(dict):
    """Numbers pre-tokens as they are met."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


class Block:
    """Frequencies of the pre-tokens of consecutive documents."""

    def __init__(self):
        self.code, self.base, self.ids, self.sizes, self.chars = Codes(), None, [], [], 0
        self.values, self.times, self.held = [], [], []

    def add(self, uid: int, doc_id: int | None, text: str) -> None:
        if self.base is None:
            self.base = uid
        found = [np.fromiter(map(self.code.__getitem__, pre_tokens(part)), np.int32) for part in stretches(text, STRETCH)]
        values, times = np.unique(np.concatenate(found), return_counts=True)
        self.values.append(values)
        self.times.append(times.astype(np.int32))
        self.held.append(len(values))
        self.ids.append(doc_id)
        self.sizes.append(len(text.encode()))
        self.chars += len(text)

    def full(self) -> bool:
        return len(self.ids) >= BLOCK_DOCS or self.chars >= BLOCK_CHARS

    def rows(self, buckets: int, hasher: WordHasher) -> Iterator[tuple]:
        """(bucket, base, pre-tokens, documents of each, document and frequency of each entry, ids, sizes): the documents
        themselves in the first row, the frequencies of a bucket in each other one."""
        none = (None,) * 4
        yield (self.base % buckets, self.base, *none, self.ids, self.sizes)
        if not self.code:
            return
        words, values = list(self.code), np.concatenate(self.values)
        docs, times = np.repeat(np.arange(len(self.ids), dtype=np.int32), self.held), np.concatenate(self.times)
        count = np.bincount(values, minlength=len(words))
        place = hasher("\n".join(words).encode())
        common = count > max(COMMON_DOCS, len(self.ids) // COMMON_SHARE)
        place = (np.where(common, mix(place + np.uint64(self.base)), place) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(place, kind="stable")
        rank = np.empty(len(words), np.int32)
        rank[order] = np.arange(len(words), dtype=np.int32)
        entry = np.argsort(rank[values], kind="stable")
        docs, times, count, place = docs[entry], times[entry], count[order], place[order]
        first = np.concatenate(([0], np.cumsum(count)))
        edges = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(words)]
        order = order.tolist()
        for lo, hi in zip(edges, edges[1:]):
            part = slice(first[lo], first[hi])
            yield (int(place[lo]), self.base, "\n".join([words[i] for i in order[lo:hi]]), slim(count[lo:hi]), slim(docs[part]), slim(times[part]), None, None)


FREQUENCIES = pa.schema([("bucket", pa.int32()), ("base", pa.int64()), ("words", pa.string()), ("counts", pa.binary()), ("docs", pa.binary()), ("times", pa.binary()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))])
SUMS = pa.schema([("base", pa.int64()), ("docs", pa.binary()), ("n", pa.int32()), ("tokens", pa.binary()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))])
COUNTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


def batch_of(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _frequencies(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, hasher = Block(), WordHasher()
        for batch in batches:
            for uid, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                block.add(uid, doc_id, text.as_py() or "")
                if block.full():
                    yield batch_of(FREQUENCIES, list(block.rows(buckets, hasher)))
                    block = Block()
        if block.ids:
            yield batch_of(FREQUENCIES, list(block.rows(buckets, hasher)))

    return run


class Pieces(dict):
    """Pieces by pre-token, each counted once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; the library's threads would take those of others
        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        self.tok.no_truncation()
        self.chars = 0

    def of(self, words: list[str]) -> np.ndarray:
        new = [w for w in words if w not in self]
        chars = sum(map(len, new))
        if len(self) + len(new) > REMEMBERED or self.chars + chars > REMEMBERED_CHARS:
            self.clear()
            self.chars, new = 0, words
            chars = sum(map(len, new))
        self.chars += chars
        at = 0
        while at < len(new):  # a few pre-tokens at a time: the library's results are large
            end, room = at + 1, (1 << 16) - len(new[at])
            while end < len(new) and (room := room - len(new[end])) >= 0:
                end += 1
            part = new[at:end]
            self.update(zip(part, map(len, self.tok.encode_batch_fast(part, add_special_tokens=False))))
            at = end
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def _joined(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(path)
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):  # one row's Python objects at a time
                r = dict(zip(batch.schema.names, (c[i].as_py() for c in batch.columns)))
                if r["words"] is None:
                    rows.append((r["base"], None, None, None, r["ids"], r["sizes"]))
                    continue
                words = r["words"].split("\n")
                counts = wide(r["counts"], len(words)).astype(np.int64)
                n = int(counts.sum())
                docs, times = wide(r["docs"], n), wide(r["times"], n)
                sums = np.bincount(docs, np.repeat(pieces.of(words), counts) * times).astype(np.int64)  # whole numbers below 2**53
                some = np.flatnonzero(sums)
                rows.append((r["base"], slim(some), len(some), slim(sums[some]), None, None))
            if rows:
                yield batch_of(SUMS, rows)

    return run


def _summed(rows: pa.Table) -> pa.Table:
    """One block's documents with their sums."""
    rows = rows.to_pylist()
    own = next(r for r in rows if r["ids"] is not None)
    total = np.zeros(len(own["ids"]), np.int64)
    for r in rows:
        if r["n"]:
            total[wide(r["docs"], r["n"])] += wide(r["tokens"], r["n"]).astype(np.int64)
    return pa.table([pa.array(own["ids"], pa.int64()), pa.array(own["sizes"], pa.int64()), pa.array(total)], schema=COUNTS)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = LIMIT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row; a null text is empty, an empty one has no tokens.

    ``vocabulary``: path of a tokenizers file, there on every executor, whose pre-tokenizer divides at white space.  A null
    doc_id stays null; repeated rows are rows of their own; an empty table gives none.
    """
    buckets = min(BUCKETS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # Consecutive rows of a partition have consecutive uids: the first one names a block.
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), column(doc_id).cast("long").alias("doc_id"), column(text).alias("text"))
    found = rows.mapInArrow(_frequencies(buckets), "bucket int, base long, words string, counts binary, docs binary, times binary, ids array<long>, sizes array<long>")
    sums = found.repartition("bucket").mapInArrow(_joined(vocabulary), "base long, docs binary, n int, tokens binary, ids array<long>, sizes array<long>")
    # At most a block's own frequencies meet in a group.
    out = sums.groupBy("base").applyInArrow(_summed, "doc_id long, n_bytes long, n_tokens long")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
