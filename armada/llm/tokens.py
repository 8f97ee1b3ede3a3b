"""Token ids by a public tokenizer, and their storage as directly addressable codes.

Method: every id is split into 8-bit chunks, lowest first.  Level 0 holds the first chunk of all ids, level l + 1 the
next chunk of those ids that have one; a continuation bitmap a level says which, and a rank directory (ones before each
512-bit block) turns a position of one level into that of the next.  Any id is thus read by a few array accesses
(token_at), without decoding what stands around it.
"""

from __future__ import annotations

import re
import zlib
from codecs import charmap_decode
from array import array
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from armada.llm.common import fresh_path, partitions, table

VOCABULARY = "byte_bpe_50k.json"
SPECIAL = "<|endoftext|>"
RANK_BITS = 512
#: Tokens after which a segment (one row of the file) is closed.
SEGMENT_TOKENS = 1 << 18
#: A space between two white-space characters: only there can a piece of the pre-tokenizer reach over a cut at spaces.
UNSAFE = re.compile(r"\s \s")
#: Byte-level vocabularies write visible Latin-1 bytes as themselves and the others, in order, as the characters from U+0100.
VISIBLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
HIDDEN = [b for b in range(0x100) if b not in VISIBLE]
BYTE_LEVEL = "".join(chr(b if b in VISIBLE else 0x100 + HIDDEN.index(b)) for b in range(0x100))
#: Letters on which all Unicode versions agree, and the characters of texts that are cut into pieces here.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
PLAIN = re.compile(rf"[\t\n\r\x20-\x7e{LETTERS}]*")
#: The vocabulary's published pattern, for plain texts.
PIECE = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{LETTERS}]+| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+")


class Pieces(dict):
    """Ids of pieces, encoded when first asked for; an older generation is asked before.  Keys over LONG characters are not kept."""

    LONG = 64

    def __init__(self, encode: Callable[[str], bytes], old: dict[str, bytes]):
        super().__init__()
        self.encode, self.old = encode, old

    def __missing__(self, key: str) -> bytes:
        found = self.old.get(key) or self.encode(key)
        if len(key) <= self.LONG:
            self[key] = found
        return found


class Encoder:
    """Ids of whole texts, as tokenizers' encode(text, add_special_tokens=False) gives them.

    A text of plain characters is cut into pieces by the vocabulary's published pattern, and the library's model encodes
    the pieces that aren't remembered.  In other texts the words with characters beyond PLAIN, on which Unicode versions may
    differ, go through the library's own pre-tokenizer; a word takes its leading space along, as no piece joins a character
    before a single space to one after it.  Where a cut at spaces isn't safe, or with a special token, the text goes to the
    library whole.  Two generations of pieces are remembered: once the younger has LIMIT of them it becomes the older, and
    pieces met again move to the younger, so the common ones stay and memory is bounded.
    """

    LIMIT = 300_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.code = np.dtype(self.dtype).char
        self.pieces = Pieces(self.piece, {})

    @cached_property
    def widths(self) -> np.ndarray:
        """How many bytes of text each id stands for: one a character of the vocabulary's entry."""
        entries = self.tokenizer.get_vocab(with_added_tokens=True)
        found = np.zeros(max(entries.values()) + 1, np.int32)
        found[list(entries.values())] = [len(entry) for entry in entries]
        return found

    def piece(self, piece: str) -> bytes:
        """Ids of one piece of the pre-tokenizer; the model reads its UTF-8 bytes as visible characters."""
        return array(self.code, [t.id for t in self.tokenize(charmap_decode(piece.encode(), "strict", BYTE_LEVEL)[0])]).tobytes()

    def plain(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, PIECE.findall(text)))

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def text(self, text: str | None) -> np.ndarray:
        if len(self.pieces) > self.LIMIT:
            self.pieces.old = {}
            self.pieces = Pieces(self.piece, self.pieces)
        if not text or SPECIAL in text:
            found = self.whole(text or "")
        elif PLAIN.fullmatch(text):
            found = self.plain(text)
        elif UNSAFE.search(text):
            found = self.whole(text)
        else:
            words = [" " + w for w in text.split(" ")]
            words[0] = words[0][1:]
            found = b"".join([self.plain(w) if PLAIN.fullmatch(w) else self.whole(w) for w in words])
        return np.frombuffer(found, self.dtype)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """One array of ids a text; null counts as empty."""
        return [self.text(t) for t in texts]


_ENCODERS: dict[str, Encoder] = {}


def encoder_path() -> str:
    """The public byte-level vocabulary of this host."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def encoder(path: str | None = None) -> Encoder:
    """One encoder a process and vocabulary; without a path the host's."""
    path = path or encoder_path()
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def crc(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def dac_encode(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """Levels of chunks, continuation bitmaps and rank directories of an array of ids.  No ids: one empty level."""
    levels, bitmaps, ranks, rest = [], [], [], ids
    while True:
        levels.append(rest.astype(np.uint8).tobytes())
        more = rest > 0xFF
        bitmaps.append(np.packbits(more, bitorder="little").tobytes())
        ones = np.add.reduceat(more.view(np.uint8), np.arange(0, len(more), RANK_BITS), dtype=np.int64) if len(more) else np.zeros(0, np.int64)
        ranks.append(np.concatenate([[0], np.cumsum(ones)]).astype("<u4").tobytes())
        if not more.any():
            return levels, bitmaps, ranks
        rest = rest[more] >> rest.dtype.type(8)


def dac_decode(levels: list[bytes], bitmaps: list[bytes]) -> np.ndarray:
    """All ids, level by level from the last to the first."""
    out = np.zeros(0, np.uint32)
    for level, bitmap in zip(levels[::-1], bitmaps[::-1], strict=True):
        chunk = np.frombuffer(level, np.uint8).astype(np.uint32)
        more = np.unpackbits(np.frombuffer(bitmap, np.uint8), count=len(chunk), bitorder="little").astype(bool)
        chunk[more] |= out << np.uint32(8)
        out = chunk
    return out


def token_at(levels: list[bytes], bitmaps: list[bytes], ranks: list[bytes], i: int) -> int:
    """The id at position i by direct access: at each level one chunk, one bit and one rank."""
    value, shift = 0, 0
    for level, bitmap, directory in zip(levels, bitmaps, ranks, strict=True):
        value |= level[i] << shift
        if not bitmap[i >> 3] >> (i & 7) & 1:
            break
        block = i // RANK_BITS
        before = int.from_bytes(directory[4 * block : 4 * block + 4], "little")
        bits = int.from_bytes(bitmap[block * RANK_BITS // 8 : (i >> 3) + 1], "little")
        i = before + (bits & ((1 << (i - block * RANK_BITS)) - 1)).bit_count()
        shift += 8
    return value


SEGMENTS = "shard int, segment int, shard_start long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, levels array<binary>, bitmaps array<binary>, ranks array<binary>"


def write_token_file(docs: DataFrame, path: str, end_id: int = 2, vocabulary: str | None = None, shards: int | None = None) -> None:
    """Encode docs (doc_id long, text string) and write their ids to path, in ascending doc_id order.

    path/segments: one row a segment of whole documents of one shard (a range of doc_id); path/manifest: one row a shard
    with the ids before it.  Null text: only the end id.  Null doc_id sorts first; equal doc_ids are ordered by text.  An
    empty table gives an empty file.  Other columns are ignored.  Texts cross the network once; a task holds one segment.
    """
    spark = docs.sparkSession

    def segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(vocabulary)
        end = np.array([end_id], enc.dtype)
        ids, held, size, number, before, shard = [], [], 0, 0, 0, 0

        def close() -> pd.DataFrame:
            levels, bitmaps, ranks = dac_encode(np.concatenate(ids))
            return pd.DataFrame([(shard, number, before, size, [d for d, _ in held], [n for _, n in held], levels, bitmaps, ranks)], columns=["shard", "segment", "shard_start", "n_tokens", "doc_ids", "doc_tokens", "levels", "bitmaps", "ranks"])

        for pdf in batches:
            for start in range(0, len(pdf), 256):
                part = pdf.iloc[start : start + 256]
                shard = int(part["shard"].iloc[0])
                for doc, own in zip(part["doc_id"], enc.encode(list(part["text"])), strict=True):
                    ids += [own, end]
                    held.append((None if pd.isna(doc) else int(doc), len(own) + 1))
                    size += len(own) + 1
                    if size >= SEGMENT_TOKENS:
                        yield close()
                        before, number = before + size, number + 1
                        ids, held, size = [], [], 0
        if held:
            yield close()

    dealt = docs.select("doc_id", "text").repartitionByRange(shards or partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    dealt.withColumn("shard", F.spark_partition_id()).mapInPandas(segments, SEGMENTS).write.option("compression", "none").option("parquet.block.size", 32 << 20).parquet(f"{path}/segments")
    sizes = {r[0]: r[1] for r in spark.read.parquet(f"{path}/segments").groupBy("shard").agg(F.sum("n_tokens")).collect()}  # one number a shard
    rows, before = [], 0
    for shard in sorted(sizes):
        rows.append((shard, before, sizes[shard]))
        before += sizes[shard]
    spark.createDataFrame(rows, "shard int, first_token long, n_tokens long").coalesce(1).write.parquet(f"{path}/manifest")


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a token file: doc_id, start (ids before it), n_tokens, ids_crc32; decoded from the file alone."""

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                ids = dac_decode(list(row.levels), list(row.bitmaps))
                sizes = np.asarray(row.doc_tokens, np.int64)
                starts = np.concatenate([[0], np.cumsum(sizes)])
                yield pd.DataFrame({"doc_id": pd.array([None if pd.isna(x) else int(x) for x in row.doc_ids], "Int64"), "start": row.first_token + row.shard_start + starts[:-1], "n_tokens": sizes, "ids_crc32": [crc(ids[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)]})

    manifest = spark.read.parquet(f"{path}/manifest").select("shard", "first_token")  # one row a shard
    segments = spark.read.parquet(f"{path}/segments").select("shard", "shard_start", "doc_ids", "doc_tokens", "levels", "bitmaps")
    return segments.join(F.broadcast(manifest), "shard").mapInPandas(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokens_at(spark: SparkSession, path: str, positions: list[int]) -> DataFrame:
    """The ids at a few global positions, by direct access: only the segments that hold one are read, none is decoded."""
    wanted = spark.createDataFrame([(int(p),) for p in positions], "position long")
    manifest = spark.read.parquet(f"{path}/manifest").select("shard", "first_token")
    segments = spark.read.parquet(f"{path}/segments").join(F.broadcast(manifest), "shard").withColumn("first", F.col("first_token") + F.col("shard_start"))
    hits = segments.join(F.broadcast(wanted), (F.col("position") >= F.col("first")) & (F.col("position") < F.col("first") + F.col("n_tokens")))

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"position": pdf["position"], "id": [token_at(list(r.levels), list(r.bitmaps), list(r.ranks), int(r.position - r.first)) for r in pdf.itertuples()]})

    return hits.select("position", "first", "levels", "bitmaps", "ranks").mapInPandas(look, "position long, id long")


def op2_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-file")
    write_token_file(table(spark, sf_dir, "documents"), path)
    return read_token_file(spark, path)
