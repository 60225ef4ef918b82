"""Token ids packed in the fewest bits that a vocabulary needs.

The packed format is a Parquet table of segments. A segment holds the ids of
consecutive documents (whole ones; a long text is one segment): each id takes
``bits`` bits, least bit first. The ids are cut into blocks of ``BLOCK``; a block
starts on a byte, and ``block_offsets`` says which, so any range of ids is read
by unpacking the blocks it touches, with numpy, and no others. ``shard`` and
``segment`` give the order; a second column pair has the documents and where
their ids begin in the segment.

Rows are range-partitioned by doc_id and sorted before they are encoded, so
shards follow each other in doc_id order. The first id of a shard is the sum
over the shards before it; one row a shard is what that sum runs over.

The tokenizers of this module split at white space and drop it, so equal words
have equal ids wherever they stand. A task encodes each word that it meets once
(until its table of words is full and the words that came once are forgotten) and looks it up afterwards.
"""

from __future__ import annotations

import os
import re
import string
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from functools import cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lapwing.llm.storage import new_path
from lapwing.llm.words import slices

#: Ids of a block; ids after which a segment is closed; words that a task remembers; characters of a text and of several short ones encoded at once; words of letters that are one text for the tokenizer.
BLOCK, SEGMENT, REMEMBERED, AT_ONCE, TOGETHER, JOINED = 4096, 1 << 20, 500_000, 1 << 20, 1 << 13, 1024

_SPACE = re.compile(r"[ \t\n\r\f\v]+")
#: ASCII marks, without the apostrophe, which may belong to what follows it.
_MARKS = string.punctuation.replace("'", "")
_SCHEMA = "shard int, segment int, first long, bits int, n_ids long, block_offsets array<long>, payload binary, doc_ids array<long>, doc_offsets array<long>"


@cache
def _ends_a_word(last: str) -> bool:
    """Whether marks after this character are pieces of their own: it is an ASCII letter or digit, or a letter that normalises to one letter, without a combining mark."""
    if last.isascii():
        return last.isalnum()
    found = unicodedata.normalize("NFC", unicodedata.normalize("NFC", last).lower())
    return len(found) == 1 and unicodedata.category(last)[0] == unicodedata.category(found)[0] == "L"


def bits_for(size: int) -> int:
    """Bits that hold each of ``size`` ids."""
    return max(1, (size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """The ids one after another, least bit first, filled up to a whole byte."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    each = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(each.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    each = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return each @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


def pack_blocks(ids: np.ndarray, bits: int) -> tuple[bytes, list[int]]:
    blocks = [pack(ids[i : i + BLOCK], bits) for i in range(0, len(ids), BLOCK)]
    return b"".join(blocks), np.cumsum([0, *map(len, blocks)]).tolist()


def read_ids(payload: bytes, block_offsets, n_ids: int, bits: int, start: int, end: int) -> np.ndarray:
    """Ids ``start`` to ``end`` of a segment: only the blocks that hold them are unpacked."""
    if end <= start:
        return np.zeros(0, np.uint32)
    a, b = start // BLOCK, (end - 1) // BLOCK
    parts = [unpack(payload[block_offsets[k] : block_offsets[k + 1]], min(BLOCK, n_ids - k * BLOCK), bits) for k in range(a, b + 1)]
    return np.concatenate(parts)[start - a * BLOCK : end - a * BLOCK]


class _Known(dict):
    """The numbers of known words; -1 for any other, which isn't added."""

    def __missing__(self, word: str) -> int:
        return -1


class WordEncoder:
    """Ids of texts under a tokenizer that splits at white space and drops it."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ending = np.zeros(self.size, bool)
        self.ending[[i for w, i in self.tokenizer.get_vocab().items() if w.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = _Known()
        self.count, self.ids, self.begins, self.again = 0, np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, bool)

    def _renew(self) -> None:
        """Forgets the words that no later text had; all of them, if too many are left."""
        kept = [w for w, k in self.known.items() if self.again[k]]
        if len(kept) > REMEMBERED // 2:
            kept = []
        ids, lengths = self._ids_of(np.array([self.known[w] for w in kept], np.int64))
        self._forget()
        if kept:
            self._add(kept, ids, lengths)

    def _learn(self, new: list[str]) -> None:
        """Adds words. Marks after what ``_ends_a_word`` are pieces of their own for the tokenizer, so only what is before them is encoded, once for either case."""
        known, joined = self.known, " ".join(new)
        special = [x for x in self.special if x in joined]  # the tokenizer finds these before anything else
        letters, rest, plain, marked = {}, {}, [], []
        for w in new:
            stem, marks = w, ""
            if not w.isalpha():
                if special and any(x in w for x in special):
                    rest[w] = None
                    continue
                stem = w.rstrip(_MARKS)
                if stem and _ends_a_word(stem[-1]):
                    marks = w[len(stem) :]
                else:
                    stem = w
            if stem.isascii():
                stem = stem.lower()
            if stem not in known:
                (letters if stem.isalpha() else rest)[stem] = None
            if marks:
                if marks not in known:
                    rest[marks] = None
                marked.append((w, stem, marks))
            elif stem != w:
                plain.append((w, stem))
        letters = list(letters)
        for at in range(0, len(letters), JOINED):
            if not self._encode_new(letters[at : at + JOINED]):
                rest |= dict.fromkeys(letters[at : at + JOINED])
        if rest:
            found = [e.ids for e in self.tokenizer.encode_batch_fast(list(rest), add_special_tokens=False)]
            self._add(list(rest), np.fromiter(chain.from_iterable(found), np.uint32), np.array([len(x) for x in found]))
        for w, stem in plain:
            known[w] = known[stem]
        if marked:
            ids, lengths = self._ids_of(np.array([known[x] for _, *both in marked for x in both]))
            self._add([x[0] for x in marked], ids, lengths.reshape(-1, 2).sum(axis=1))

    def _encode_new(self, letters: list[str]) -> bool:
        """Words of letters are encoded as one text and cut at the ids that end a word, if these are as many as the words."""
        ids = np.array(self.tokenizer.encode(" ".join(letters), add_special_tokens=False).ids, np.uint32)
        ends = np.flatnonzero(self.ending[ids]) + 1
        good = len(ends) == len(letters) and len(ids) > 0 and ends[-1] == len(ids)
        if good:
            self._add(letters, ids, np.diff(ends, prepend=0))
        return good

    def _add(self, words: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        """Adds words whose ids follow each other."""
        ends = self.begins[self.count] + np.cumsum(lengths)
        while ends[-1] > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.count + len(words) >= len(self.begins):
            self.begins, self.again = np.concatenate([self.begins, np.zeros_like(self.begins)]), np.concatenate([self.again, np.zeros_like(self.again)])
        self.ids[self.begins[self.count] : ends[-1]] = ids
        self.begins[self.count + 1 : self.count + 1 + len(words)] = ends
        self.known.update(zip(words, range(self.count, self.count + len(words)), strict=True))
        self.count += len(words)

    def _ids_of(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of known words, by their numbers, one after another, and how many each has."""
        begins, lengths = self.begins[k], self.begins[k + 1] - self.begins[k]
        ends = np.cumsum(lengths)
        return self.ids[np.repeat(begins - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)], lengths

    def encode(self, text: str) -> np.ndarray:
        """The ids of the text; one of many words is encoded piece by piece, cut at white space."""
        out, at = [], 0
        while at < len(text):
            to = at + AT_ONCE
            cut = _SPACE.search(text, to) if to < len(text) else None
            to = cut.end() if cut else len(text)
            piece = text[at:to]
            for other in "\t\n\r\f\v":
                piece = piece.replace(other, " ")
            out.append(self._encode(piece.split(" "))[0])
            at = to
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def encode_all(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text; short ones are looked up together, as a call costs more than a few words."""
        words: list[str] = []
        counts: list[int] = []
        held = 0
        for text in texts:
            if counts and held + len(text) > TOGETHER:
                yield from self._each(words, counts)
                words, counts, held = [], [], 0
            if len(text) > TOGETHER:
                yield self.encode(text)
                continue
            for other in "\t\n\r\f\v":
                text = text.replace(other, " ")
            own = text.split(" ")
            words += own
            counts.append(len(own))
            held += len(text)
        if counts:
            yield from self._each(words, counts)

    def _each(self, words: list[str], counts: list[int]) -> Iterator[np.ndarray]:
        ids, lengths = self._encode(words)
        ends = np.cumsum(lengths)[np.cumsum(counts) - 1].tolist()
        return (ids[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True))

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words, one after another, and how many each has."""
        if len(self.known) > REMEMBERED:
            self._renew()
        k = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        at = np.flatnonzero(k < 0)
        self.again[k if not len(at) else k[k >= 0]] = True
        if len(at):
            new = [words[i] for i in at.tolist()]
            self._learn(list(dict.fromkeys(new)))
            k[at] = [self.known[w] for w in new]
        return self._ids_of(k)


_encoders: dict[str, WordEncoder] = {}


def _segments(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    encoder = _encoders[path]
    bits, end = bits_for(encoder.size), np.array([end_id], np.uint32)
    shard, segment, first = TaskContext.get().partitionId(), 0, 0
    docs: list[int | None] = []
    parts: list[np.ndarray] = []
    held = 0

    def closed() -> pa.RecordBatch:
        ids = np.concatenate(parts)
        payload, offsets = pack_blocks(ids, bits)
        row = {"shard": shard, "segment": segment, "first": first, "bits": bits, "n_ids": len(ids), "block_offsets": offsets, "payload": payload, "doc_ids": docs, "doc_offsets": np.cumsum([0, *map(len, parts)]).tolist()}
        return pa.RecordBatch.from_pylist([row], pa.schema({"shard": pa.int32(), "segment": pa.int32(), "first": pa.int64(), "bits": pa.int32(), "n_ids": pa.int64(), "block_offsets": pa.list_(pa.int64()), "payload": pa.binary(), "doc_ids": pa.list_(pa.int64()), "doc_offsets": pa.list_(pa.int64())}))

    for rows in slices(batches, "text"):
        found = encoder.encode_all([text or "" for text in rows.column("text").to_pylist()])
        for doc_id, own in zip(rows.column("doc_id").to_pylist(), found, strict=True):
            ids = np.concatenate((own, end))
            if held and held + len(ids) > SEGMENT:
                yield closed()
                segment, first, docs, parts, held = segment + 1, first + held, [], [], 0
            docs.append(doc_id)
            parts.append(ids)
            held += len(ids)
    if held:
        yield closed()


def write_packed(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Writes the ids of every text of ``docs`` (doc_id, text), each followed by ``end_id``, in ascending doc_id order.

    A null or empty text has the end id alone. Rows of one doc_id follow each
    other in the order of their texts; a null doc_id comes first. An empty table
    gives a folder without segments. Other columns are not looked at.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(partial(_segments, path=tokenizer, end_id=end_id), _SCHEMA).write.parquet(path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            bounds = row["doc_offsets"]
            crcs = [zlib.crc32(read_ids(row["payload"], row["block_offsets"], row["n_ids"], row["bits"], a, b).astype("<u4").tobytes()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["doc_ids"], pa.int64()), pa.array([row["base"] + row["first"] + b for b in bounds[:-1]], pa.int64()), pa.array(np.diff(bounds), pa.int64()), pa.array(crcs, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document, from the packed ids alone."""
    segments = spark.read.schema(_SCHEMA).parquet(path)
    shards = segments.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    shards = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    rows = segments.join(F.broadcast(shards), "shard")  # one row for each task that wrote
    return rows.select("base", "first", "bits", "n_ids", "block_offsets", "payload", "doc_ids", "doc_offsets").mapInArrow(_documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_packed_token_ids(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "packed")
    write_packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, vocabulary(), 2)
    return read_documents(spark, path)


QUERIES: dict[str, Callable] = {"op3_packed_token_ids": op3_packed_token_ids}
