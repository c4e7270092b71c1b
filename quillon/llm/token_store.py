"""Token ids, compressed document by document with one zstandard dictionary trained on serialized id arrays."""

from __future__ import annotations

import base64
import functools
import hashlib
import warnings

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import lean, to_batch

#: How byte-level vocabularies of this kind cut texts before merging; goes with the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of a training piece, and pieces that the dictionary is trained on at most.
PIECE_CHARS, PIECES = 8_192, 4_000
_OUT = pa.schema([("doc_id", pa.int64()), ("shard", pa.int32()), ("offset", pa.int64()), ("n_bytes", pa.int32()), ("n_tokens", pa.int64()), ("dict_hash", pa.string()), ("frame", pa.binary())])
SCHEMA = "doc_id long, shard int, offset long, n_bytes int, n_tokens long, dict_hash string, frame binary"


def read_vocabulary(path: str) -> bytes:
    """A vocabulary file (a base64 token and its rank a line), read where it lies, on the driver; its bytes travel with the tasks."""
    with open(path, "rb") as f:
        return f.read()


@functools.lru_cache(4)
def encoder(vocabulary: bytes, pattern: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode(text: str, vocabulary: bytes, pattern: str = PATTERN) -> bytes:
    """A text's ids as little-endian integers: 2 bytes each if the vocabulary allows, else 4."""
    enc = encoder(vocabulary, pattern)
    return np.asarray(enc.encode_to_numpy(text, disallowed_special=()), "<u2" if enc.n_vocab <= 1 << 16 else "<u4").tobytes()


def training_pieces(docs: DataFrame, pieces: int = PIECES) -> DataFrame:
    """(text): `pieces` pieces at most, of PIECE_CHARS characters, from anywhere in the documents and from all sources.

    Every document is cut into pieces, its first no likelier to be taken than its last; each source offers those whose
    (doc_id, piece) hash lowest, and sources are taken from in turn, so that a rare one is heard beside one that holds a
    third of all rows.
    """
    cut = docs.where(F.length("text") > 0).select("doc_id", "source", F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / PIECE_CHARS).cast("int"))).alias("piece"))
    cut = cut.withColumn("h", F.xxhash64("doc_id", "piece"))
    w = Window.partitionBy("source").orderBy("h", "doc_id", "piece")
    ranked = cut.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= pieces)
    chosen = ranked.orderBy("turn", "h", "doc_id", "piece").limit(pieces).select("doc_id", "piece").distinct()
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # broadcast: `pieces` rows at most
    return found.select(F.expr(f"substring(text, piece * {PIECE_CHARS} + 1, {PIECE_CHARS})").alias("text"))


def train_dictionary(docs: DataFrame, size: int, pieces: int, vocabulary: bytes, pattern: str) -> bytes:
    """Trained on the driver on the id arrays of training_pieces(). b"", with a warning, if they are too few or too much alike to train on."""
    import zstandard

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([encode(t, vocabulary, pattern) for t in batch.column(0).to_pylist() if t], pa.binary())], names=["ids"])

    samples = sorted(bytes(r[0]) for r in training_pieces(docs, pieces).mapInArrow(lean(run), "ids binary").collect())
    try:
        if len(samples) < 8:
            raise zstandard.ZstdError(f"{len(samples)} pieces")
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError as e:
        warnings.warn(f"no dictionary could be trained ({e}): documents are compressed without one, dict_hash is empty", stacklevel=3)
        return b""


def token_store(docs: DataFrame, vocabulary: bytes, pattern: str = PATTERN, level: int = 3, dict_bytes: int = 65_536, dict_pieces: int = PIECES, dictionary: bytes | None = None) -> DataFrame:
    """One row a document: (doc_id, shard, offset, n_bytes, n_tokens, dict_hash, frame).

    frame is the document's ids, little-endian (2 bytes each for vocabularies up to 65,536), as one zstandard frame made
    with the shared dictionary; shard and offset say where it lies once save() has written the frames of each shard one
    after another. dict_hash is the SHA-256 of the dictionary, "" where the corpus is too small to train one (a warning
    says so). The dictionary is trained on a bounded sample, `dict_pieces` pieces of all sources (see training_pieces);
    that bounds training alone, every document is stored whole. vocabulary: see read_vocabulary().

    One pass without a shuffle. A null text has no frame: n_tokens, n_bytes and frame are null, and it takes no room. An
    empty text has a frame of no ids. Null ids and repeated rows keep a row each; a null source is a source like others; extra columns are ignored. An empty
    table gives no rows. Very long texts take as much of a worker's memory as their own ids.
    """
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit("")
    docs = docs.select(F.col("doc_id").cast("long"), "text", source.alias("source"))
    data = train_dictionary(docs, dict_bytes, dict_pieces, vocabulary, pattern) if dictionary is None else dictionary
    name = hashlib.sha256(data).hexdigest() if data else ""

    def run(batches):
        import zstandard
        from pyspark import TaskContext

        shared = zstandard.ZstdCompressionDict(data) if data else None
        if shared:
            shared.precompute_compress(level=level)
        press = zstandard.ZstdCompressor(level=level, dict_data=shared) if shared else zstandard.ZstdCompressor(level=level)
        width = 2 if encoder(vocabulary, pattern).n_vocab <= 1 << 16 else 4
        shard, offset = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a in range(0, len(texts), 1000):
                frames, tokens, offsets = [], [], []
                for t in texts[a : a + 1000]:
                    raw = None if t is None else encode(t, vocabulary, pattern)
                    frames.append(None if t is None else press.compress(raw))
                    tokens.append(None if t is None else len(raw) // width)
                    offsets.append(offset)
                    offset += len(frames[-1] or b"")
                yield to_batch(_OUT, doc_id=ids[a : a + 1000], shard=[shard] * len(frames), offset=offsets, n_bytes=[None if f is None else len(f) for f in frames], n_tokens=tokens, dict_hash=[name] * len(frames), frame=frames)

    out = docs.select("doc_id", "text").mapInArrow(lean(run), SCHEMA)
    out.dictionary = data
    return out


def save(store: DataFrame, dictionary: bytes, path: str) -> None:
    """Writes token_store()'s rows under a shared path (any file system that pyarrow knows): a dictionary, a file of frames a shard and an offset index. Written again after a lost task, a shard's file is the same."""
    import uuid

    fs, root = pyarrow.fs.FileSystem.from_uri(path)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/ids.dict") as f:
        f.write(dictionary)

    def run(batches):
        own, base = pyarrow.fs.FileSystem.from_uri(path)
        out, shard, temp = None, None, None
        for batch in batches:
            for i in range(batch.num_rows):
                if out is None:
                    shard, temp = batch["shard"][i].as_py(), f"{base}/.{uuid.uuid4().hex}"
                    out = own.open_output_stream(temp)
                out.write(batch["frame"][i].as_py() or b"")
            yield batch.select(["doc_id", "shard", "offset", "n_bytes", "n_tokens", "dict_hash"])
        if out is not None:
            out.close()
            own.move(temp, f"{base}/shard-{shard:06d}.bin")

    store.mapInArrow(run, SCHEMA.replace(", frame binary", "")).write.mode("overwrite").parquet(f"{path}/index")


def read_document(path: str, shard: int, offset: int, n_bytes: int, width: int = 2) -> list[int]:
    """One document's ids: a seek, a short read, and the shared dictionary."""
    import zstandard

    fs, root = pyarrow.fs.FileSystem.from_uri(path)
    with fs.open_input_stream(f"{root}/ids.dict") as f:
        data = f.read()
    with fs.open_input_file(f"{root}/shard-{shard:06d}.bin") as f:
        frame = f.read_at(n_bytes, offset)
    press = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data)) if data else zstandard.ZstdDecompressor()
    return np.frombuffer(press.decompress(frame), f"<u{width}").tolist()
