"""Token ids of documents as flat unsigned-integer files with 64-bit document offsets.

Layout of a folder, for shards in ascending order of document id:

    shard-00000.ids       ids one after the other, little-endian uint16, or uint32 for vocabularies over 65,536
    shard-00000.offsets   uint64: where each document starts in the shard, and the shard's length
    shard-00000.docs      int64: the document ids, and the smallest value for a null id
    index.json            width of an id, and for each shard its documents, its ids and the ids before it

Texts are encoded where they are read; only ids move, once, to range shards. Each
shard is written by one task under a name of its own attempt and then renamed, so
a lost executor's shard is simply written again. Only one line a shard reaches
the driver, which adds up the bases as prefix sums. Readers map the files.

Null text counts as empty: one end id. Null document ids come first; equal
document ids are ordered by their ids. An empty table gives no shards.
"""

from __future__ import annotations

import json
import os
import string
import zlib
from array import array
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import textkit as K

NULL_ID = np.iinfo(np.int64).min
CACHE = 300_000
PART_BYTES = 2 << 20  # text whose new pieces are encoded together


class PieceEncoder:
    """The tokenizers library behind a bounded cache of pieces between single spaces.

    With byte-level pre-tokenisation a space before a non-space sign starts a
    pre-token whatever stands around it, so the ids of a text are those of its
    pieces in a row. Texts with other white space at a piece's border go to the
    library whole, and so do texts that hold the string of an added token.
    """

    def __init__(self, path: str, cache: int = CACHE):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65536 else "<u4")
        # pieces and tokens with their ids, in two generations: what is not used again leaves with the older one
        self._limit, self._pieces, self._old, self._tokens = cache, {}, {}, {}
        self._split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self._model = self.tokenizer.model.tokenize
        self._byte_level = "ByteLevel" in json.dumps(json.loads(self.tokenizer.to_str())["pre_tokenizer"]) and self.tokenizer.normalizer is None
        self._code = "H" if self.dtype.itemsize == 2 else "I"
        self._space = "".join(t for t, _ in self._split(" "))
        outer = self

        class Signs(dict):
            """How the byte-level pre-tokeniser writes a sign."""

            def __missing__(self, sign: str) -> str:
                self[sign] = found = "".join(t for t, _ in outer._split(sign))
                return found

        self._signs = Signs()

    def _by_library(self, text: str) -> bytes:
        return b"".join([self._token(token) for token, _ in self._split(text)])

    def _piece(self, piece: str) -> bytes:
        """The ids of a space and a piece; its lines are pre-tokens of their own, unless other white space joins a line break."""
        first, *lines = piece.split("\n")
        if not lines:
            return self._words(self._space, piece)
        if not all(x and not x[0].isspace() and not x[-1].isspace() for x in (first, *lines)):
            return self._by_library(" " + piece)
        newline = self._token(self._signs["\n"])
        return self._words(self._space, first) + b"".join([newline + self._words("", x) for x in lines])

    def _words(self, space: str, text: str) -> bytes:
        """Letters, and marks after them, are pre-tokens for certain."""
        word = text.rstrip(string.punctuation)
        if not word.isalpha():
            return self._by_library((" " if space else "") + text)
        token = space + (word if word.isascii() else "".join(map(self._signs.__getitem__, word)))
        ids = self._tokens.get(token) or self._token(token)
        if len(word) == len(text):
            return ids
        return ids + self._token(text[len(word) :])

    def _token(self, token: str) -> bytes:
        ids = self._tokens.get(token)
        if ids is None:
            if len(self._tokens) >= self._limit:
                self._tokens.clear()
            ids = self._tokens[token] = array(self._code, [x.id for x in self._model(token)]).tobytes()
        return ids

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def __call__(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; pieces that are new to the cache are encoded once for all."""
        if not self._byte_level:
            return [self.whole(x) for x in texts]
        cut = [x.split(" ") for x in texts]
        pieces, old, odd = self._pieces, self._old, set()
        for piece in set().union(*[x[1:] for x in cut]) - pieces.keys():
            if not piece or piece[0].isspace() or piece[-1].isspace():
                odd.add(piece)
            else:
                pieces[piece] = old.get(piece) or self._piece(piece)
        out = []
        for text, (head, *rest) in zip(texts, cut):
            if any(t in text for t in self._added) or rest and (not head or head[0].isspace() or head[-1].isspace() or not odd.isdisjoint(rest)):
                out.append(self.whole(text))
            else:
                out.append((self._by_library(head) if head else b"") + b"".join(map(pieces.__getitem__, rest)))
        if len(pieces) >= self._limit:
            self._old, self._pieces = pieces, {}
        return out


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder in each Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def encode(docs: DataFrame, tokenizer: str, end_id: int, bounds: list[int]) -> DataFrame:
    """(doc_id, ids, shard): ids as bytes with the end id; shard by the bounds that doc_id has reached."""
    edges = np.array(bounds, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_ = encoder(tokenizer)
        end = np.array([end_id], encode_.dtype).tobytes()
        for batch in batches:
            keys = batch.column(0).fill_null(int(NULL_ID))
            shard = np.searchsorted(edges, keys.to_numpy(), side="right").astype(np.int32)
            known = pa.RecordBatch.from_pydict({"doc_id": keys, "text": batch.column(1), "shard": pa.array(shard)})
            for part in K.chunks(known, size=PART_BYTES):
                ids = encode_.encode_all([x or "" for x in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "ids": pa.array([x + end for x in ids], pa.binary()), "shard": part.column("shard")})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids binary, shard int")


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, shards: int | None = None) -> dict:
    """Writes the files and returns the index. shards: by default as many as shuffle partitions."""
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = docs.select(F.col("doc_id").cast("long").alias("k")).agg(F.percentile_approx("k", [i / shards for i in range(1, shards)] or [0.5], 100 * shards)).first()[0] or []
    bounds = sorted(set(bounds))
    wide = encoder(tokenizer).dtype.itemsize
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        attempt, writer, rows = TaskContext.get().taskAttemptId(), None, []
        for batch in batches:
            shard = batch.column(2).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    if writer is None or writer.shard != shard[a]:
                        rows += [writer.close()] if writer else []
                        writer = _ShardWriter(folder, int(shard[a]), attempt, wide)
                    writer.add(batch.slice(a, b - a))
        rows += [writer.close()] if writer else []
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("shard", pa.int32()), ("documents", pa.int64()), ("ids", pa.int64())]))

    encoded = encode(docs, tokenizer, end_id, bounds)
    dealt = encoded.repartitionById(len(bounds) + 1, F.col("shard"))
    lines = dealt.sortWithinPartitions("shard", "doc_id", "ids").mapInArrow(run, "shard int, documents long, ids long").collect()  # a line a shard
    index, base = {"bytes_per_id": wide, "shards": []}, 0
    for line in sorted(lines, key=lambda x: x["shard"]):
        index["shards"].append({"shard": line["shard"], "documents": line["documents"], "ids": line["ids"], "base": base})
        base += line["ids"]
    with store.open_output_stream(f"{root}/index.json") as out:
        out.write(json.dumps(index).encode())
    return index


class _ShardWriter:
    def __init__(self, folder: str, shard: int, attempt: int, wide: int):
        self.store, self.root = fs.FileSystem.from_uri(folder)
        self.shard, self.attempt, self.wide = shard, attempt, wide
        self.out = {k: self.store.open_output_stream(self._name(k, True)) for k in ("ids", "offsets", "docs")}
        self.documents, self.ids = 0, 0

    def _name(self, kind: str, open_: bool) -> str:
        return f"{self.root}/shard-{self.shard:05d}.{kind}" + f".{self.attempt}" * open_

    def add(self, batch: pa.RecordBatch) -> None:
        ids = batch.column(1).to_pylist()
        lengths = np.array([len(x) // self.wide for x in ids], np.uint64)
        ends = self.ids + np.cumsum(lengths)
        self.out["ids"].write(b"".join(ids))
        self.out["offsets"].write((ends - lengths).astype("<u8").tobytes())
        self.out["docs"].write(batch.column(0).to_numpy().astype("<i8").tobytes())
        self.documents, self.ids = self.documents + len(ids), int(ends[-1])

    def close(self) -> dict:
        self.out["offsets"].write(np.array([self.ids], "<u8").tobytes())
        for kind, out in self.out.items():
            out.close()
            self.store.move(self._name(kind, True), self._name(kind, False))
        return {"shard": self.shard, "documents": self.documents, "ids": self.ids}


def mapped(folder: str, name: str, dtype: str) -> np.ndarray:
    """A file as an array: mapped if the folder is a mounted one, else read."""
    url = urlparse(folder)
    if url.scheme in ("", "file"):
        path = os.path.join(url.path, name)
        return np.memmap(path, dtype, mode="r") if os.path.getsize(path) else np.zeros(0, dtype)
    store, root = fs.FileSystem.from_uri(folder)
    with store.open_input_file(f"{root}/{name}") as f:
        return np.frombuffer(f.read(), dtype)


def read_token_files(spark: SparkSession, folder: str, index: dict | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files.

    ids_crc32: unsigned crc32 of the ids as little-endian unsigned 32-bit integers.
    """
    if index is None:
        store, root = fs.FileSystem.from_uri(folder)
        with store.open_input_file(f"{root}/index.json") as f:
            index = json.loads(f.read())
    dtype = f"<u{index['bytes_per_id']}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                name = f"shard-{shard:05d}"
                ids, offsets, docs = mapped(folder, f"{name}.ids", dtype), mapped(folder, f"{name}.offsets", "<u8").astype(np.int64), mapped(folder, f"{name}.docs", "<i8")
                for a in range(0, len(docs), 4096):
                    some = offsets[a : a + 4097]
                    crc = [zlib.crc32(ids[x:y].astype("<u4")) for x, y in zip(some, some[1:])]
                    keys = np.array(docs[a : a + 4096], np.int64)
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(keys, mask=keys == NULL_ID), "start": pa.array(base + some[:-1]), "n_tokens": pa.array(np.diff(some)), "ids_crc32": pa.array(crc, pa.int64())})

    rows = [(x["shard"], x["base"]) for x in index["shards"]]
    frame = spark.createDataFrame(rows, "shard int, base long")
    return frame.repartitionById(max(1, len(rows)), F.col("shard") % max(1, len(rows))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
