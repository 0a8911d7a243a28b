"""Token-id output: documents as shards of frames, and their reading back.

Documents are range-partitioned and sorted by doc_id; each partition is a shard. A shard is a sequence of frames; a frame
holds whole documents, of about FRAME ids (one longer document is a frame of its own), and is a row of a Parquet table:
shard, frame, doc_ids, lens, n_ids, data (coder.encode of all ids). Parquet's commit makes writing safe against lost tasks.

Tokenizing goes word by word with a bounded cache: this vocabulary's tokenizer drops white space and its patterns never
span it, so a text's ids are its words' ids in turn. With a tokenizer that does otherwise use by_word=False. A batch of
texts is cut at once, also between a Latin letter and an ASCII sign or digit behind it, which no pattern spans either, and
in lower case where no accent follows; each different piece is then encoded once. Texts with a special token are not cut.

Defined cases: a null or empty text has only the end id; null doc_ids come first; rows with an equal doc_id are ordered by
text; an empty table gives no frames; columns other than doc_id and text play no part.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import coder
from .common import bounded, lean, shared_dir, ship, table

END, FRAME, CACHE = 1, coder.BLOCK * coder.LANES, 200_000
#: Bytes of texts that are cut at once; letters below this are known to be such in every version of Unicode at hand.
PORTION, LATIN = 1 << 20, 0x250
_GAP = re.compile("[ \t\n\r]+")
_ROW = "shard int, frame int, doc_ids array<long>, lens array<long>, n_ids long, data binary"


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Words(dict):
    """Ids of words as bytes; a bounded cache of those that come first, among them the common ones. A worker has one for all its tasks."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        t = Tokenizer.from_file(path)
        self.encode, self.model = t.encode, t.model
        self.special = [x.content.lower().encode() for x in t.get_added_tokens_decoder().values()]
        # whether runs of small letters reach the model as their bytes, and those in capitals alike
        abc, norm, pre = "".join(c for c in map(chr, range(LATIN)) if c.isalpha() and c == c.lower()), t.normalizer, t.pre_tokenizer
        whole = lambda x: [p for p, _ in pre.pre_tokenize_str(norm.normalize_str(x))]
        one = "abcdefghijklmnopqrstuvwxyz"
        self.plain = bool(norm and pre) and whole(one.upper()) == whole(one) == [one] and whole("a.") == ["a", "."] and not any(x.isalpha() for x in self.special)
        # the characters that stand for bytes
        self.bytes = dict(zip(abc.encode().decode("latin-1"), "".join(whole(abc)), strict=False)) if self.plain else {}
        self.plain &= whole(abc) == [self.stand_in(abc)]

    def stand_in(self, word: str) -> str:
        return word if word.isascii() else "".join(map(self.bytes.get, word.encode().decode("latin-1")))

    def __missing__(self, word: str) -> bytes:
        if self.plain and word.isalpha() and max(word) < chr(LATIN) and word == word.lower():
            ids = [t.id for t in self.model.tokenize(self.stand_in(word))]
        else:
            ids = self.encode(word, add_special_tokens=False).ids
        ids = struct.pack(f"<{len(ids)}H", *ids)
        if len(self) < CACHE and len(word) <= 40:
            self[word] = ids
        return ids


def _pieces(buf: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Pieces of texts (their lower-cased bytes and the places where they begin and end), and for each text the number of pieces before its end."""
    space = (buf == 32) | (buf == 9) | (buf == 10) | (buf == 13)
    letter = (buf | 32) - np.uint8(97) < 26
    sign = (buf < 128) & ~letter
    # the second bytes of letters from U+00C0 to U+023F; but two signs are among them, and U+0130, small, ends in an accent
    letter[1:] |= (buf[:-1] - np.uint8(0xC3) < 6) & ((buf[:-1] != 0xC3) | (buf[1:] & 0x1F != 0x17)) & ((buf[:-1] != 0xC4) | (buf[1:] != 0xB0))
    start = np.ones(len(buf), np.bool_)
    # behind white space, and at a sign or digit behind a letter
    start[1:] = space[:-1] | (sign[1:] & letter[:-1])
    start[offsets[:-1][offsets[:-1] < len(buf)]] = True
    kept = ~space
    starts = np.flatnonzero(start & kept)
    ends = np.append(np.cumsum(kept, dtype=np.int32)[starts] - 1, np.count_nonzero(kept)).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(buf[kept])), np.searchsorted(starts, offsets[1:])


class Encoder:
    """Ids of texts, the end id included: of one as little-endian 16-bit bytes, of a batch as an array and each text's number of them."""

    _known: dict[str, _Words] = {}

    def __init__(self, path: str, by_word: bool = True):
        if path not in self._known:
            self._known[path] = _Words(path)
        self.words, self.by_word = self._known[path], by_word
        self.end = np.array([END], "<u2").tobytes()

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return self.end
        parts = _GAP.split(text) if self.by_word else [text]
        return b"".join(map(self.words.__getitem__, parts)) + self.end

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = texts.fill_null("").cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        out, k = [], 0
        while k < len(texts):
            end = max(k + 1, int(np.searchsorted(offsets, offsets[k] + PORTION, "right")) - 1)
            out.append(self._portion(texts.slice(k, end - k), offsets[k : end + 1]))
            k = end
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, "<u2"), np.zeros(0, np.int64))

    def _portion(self, texts: pa.Array, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        plain = self.by_word and self.words.plain and offsets[-1] > offsets[0] and offsets[-1] - offsets[0] < 1 << 31
        if plain:
            buf = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
            small = buf + np.uint8(32) * (buf - np.uint8(65) < 26)
            plain = not any(x in small.tobytes() for x in self.words.special)
        if not plain:
            ids = [self(t) for t in texts.to_pylist()]
            return np.frombuffer(b"".join(ids), "<u2"), np.array([len(x) // 2 for x in ids], np.int64)
        # a capital before a character beyond ASCII may be one with its accent
        accents = np.flatnonzero(buf[1:] >= 128)
        small[accents] = buf[accents]
        pieces, upto = _pieces(small, offsets - offsets[0])
        pieces = pieces.dictionary_encode()
        ids = [*map(self.words.__getitem__, pieces.dictionary.to_numpy(zero_copy_only=False)), self.end]
        lens = np.fromiter(map(len, ids), np.int64, len(ids)) // 2
        which = np.insert(pieces.indices.to_numpy(), upto, len(ids) - 1)
        # the ids of all pieces in turn
        n = lens.take(which)
        ends = np.cumsum(n)
        at = np.repeat((np.cumsum(lens) - lens).take(which) - (ends - n), n)
        at += np.arange(len(at))
        ends = ends[upto + np.arange(len(upto))]
        return np.frombuffer(b"".join(ids), "<u2").take(at), np.diff(ends, prepend=0)


def write(docs: DataFrame, folder: str, path: str, by_word: bool = True) -> None:
    """Write the ids of all documents (doc_id, text) under folder, in doc_id order."""

    @lean
    def frames(batches):
        encode, shard, n = Encoder(path, by_word), TaskContext.get().partitionId(), 0
        parts, size = [], 0

        def flush():
            nonlocal n, parts, size
            docs_, lens, ids = zip(*parts, strict=True)
            data = coder.encode(np.concatenate(ids))
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            out = [pa.array([shard], pa.int32()), pa.array([n], pa.int32()), one(pa.concat_arrays(docs_)), one(pa.array(np.concatenate(lens))), pa.array([size]), pa.array([data], pa.binary())]
            n, parts, size = n + 1, [], 0
            return pa.RecordBatch.from_arrays(out, ["shard", "frame", "doc_ids", "lens", "n_ids", "data"])

        for batch in batches:
            ids, lens = encode.batch(batch.column(1))
            ends, k = np.cumsum(lens), 0
            while k < len(lens):
                before = int(ends[k] - lens[k])
                end = int(np.searchsorted(ends, before + FRAME - size, "right"))
                if size and end == k:
                    yield flush()
                    continue
                end = max(end, k + 1)
                parts.append((batch.column(0).slice(k, end - k), lens[k:end], ids[before : ends[end - 1]]))
                size, k = size + int(ends[end - 1]) - before, end
        if parts:
            yield flush()

    ship(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    d.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(frames, _ROW).write.mode("overwrite").parquet(folder)


def read(spark: SparkSession, folder: str, ids: bool = True) -> DataFrame:
    """Per document of a written folder: doc_id, start, n_tokens, ids_crc32 (of 32-bit ids) and, if asked for, ids, from decoded frames."""

    @lean
    def documents(batches, with_ids=ids):
        for pdf in batches:
            for f in pdf.itertuples():
                all_ids, lens = coder.decode(f.data), np.asarray(f.lens)
                ends = np.cumsum(lens)
                starts = ends - lens
                parts = [all_ids[a:b].astype("<u4") for a, b in zip(starts, ends, strict=True)]
                doc = pd.array([None if x is None or x != x else int(x) for x in f.doc_ids], dtype="Int64")
                yield pd.DataFrame({"doc_id": doc, "shard": f.shard, "frame": f.frame, "at": starts, "n_tokens": lens, "ids_crc32": [zlib.crc32(p.tobytes()) for p in parts], "ids": [p.astype(np.int32) if with_ids else None for p in parts]})

    ship(spark)
    t = spark.read.schema(_ROW).parquet(folder)
    out = t.select("shard", "frame", "doc_ids", "lens", "data").mapInPandas(documents, "doc_id long, shard int, frame int, at long, n_tokens long, ids_crc32 long, ids array<int>")
    # a row for each shard, then for each frame within its shard
    shards = t.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("below"))
    inside = Window.partitionBy("shard").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)
    base = t.select("shard", "frame", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("within")).join(shards, "shard").select("shard", "frame", (F.col("below") + F.col("within")).alias("base"))
    base = F.broadcast(base) if bounded(base, 100_000) else base
    out = out.join(base, ["shard", "frame"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "ids")
    return out if ids else out.drop("ids")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write docs to a new folder in the shared place and read it back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/tidewrack/ids-{uuid.uuid4().hex}"
    write(docs, folder, path or vocabulary())
    return read(spark, folder, ids=False)


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
