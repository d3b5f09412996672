"""Token ids in binary segments with Elias-Fano document boundaries.

A data set is a folder of Parquet files, written and committed by Spark, so that it may lie in any store and survives
lost executors. Each row is a segment: its number, the ids of all segments before it, and one binary image:

    magic "TFEF" | version u8 | id width u8 (2 or 4 bytes) | low bits u8 | 0 u8
    documents u32 | ids u32 | ids, little-endian | doc_ids, 8 bytes each | low parts | high parts

The boundaries are the numbers of ids up to the end of each document of the segment, a monotone sequence of n values up
to u. Each value's low l = floor(log2(u / n)) bits are packed side by side; its high part v is coded as a 1 at place
v + i of a bit vector. select(i), the place of the i-th 1, gives the value back: about 2 + l bits a document.
"""

from __future__ import annotations

import codecs
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm.ranges import totals_before
from tallyforge.llm.store import shared_folder
from tallyforge.llm.workers import text_batches, tidy

MAGIC, HEAD = b"TFEF", struct.Struct("<4sBBBBII")
#: Id appended to each document, ids that close a segment, and words whose ids a worker keeps.
END, SEGMENT_IDS, CACHE = 1, 1 << 22, 250_000
#: Bytes of text that are split at a time, and words that the model gets at a time.
SLICE, WORDS = 1 << 22, 4096

#: Letters whose case and composed form are plain: all normalisers agree on them.
PLAIN = "abcdefghijklmnopqrstuvwxyzàáâäæçèéêëìíîïñòóôöùúûüß"
LETTERS = PLAIN + PLAIN.replace("ß", "").upper()
#: A plain word, perhaps capital, with marks that no contraction or special token has.
_SIMPLE = f"^(?P<before>[(\\[\"*|]*)(?P<word>[{LETTERS}]+)(?P<after>[.,;:!?)\\]\"*$%&#|]*)$"
_PLAIN = f"^[{PLAIN}]+$"
#: White space for a split but not for tokenizers' regular expressions; texts with any are encoded whole.
_SPLIT_ONLY = "[\x1c-\x1f]"


class EliasFano:
    """A monotone sequence of non-negative numbers."""

    #: Every so many ones a place is kept, so that select() scans a short stretch.
    SAMPLE = 256

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        ones = np.bitwise_count(high).astype(np.int64)
        self._ones = np.cumsum(ones)

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // max(1, n)).bit_length() - 1)
        low = (values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
        places = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(places[-1]) // 8 + 1) * 8 if n else 0, np.uint8)
        high[places] = 1
        return cls(n, bits, np.packbits(low.astype(np.uint8).ravel(), bitorder="little"), np.packbits(high, bitorder="little"))

    def select(self, i: int) -> int:
        """The i-th value."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        byte = int(np.searchsorted(self._ones, i + 1))
        rest = i - (int(self._ones[byte - 1]) if byte else 0)
        place = byte * 8 + int(np.flatnonzero(np.unpackbits(self.high[byte : byte + 1], bitorder="little"))[rest])
        a, b = i * self.low_bits, (i + 1) * self.low_bits
        low = int.from_bytes(self.low[a // 8 : -(-b // 8)].tobytes(), "little") >> (a % 8) & ((1 << self.low_bits) - 1)
        return ((place - i) << self.low_bits) | low

    def values(self) -> np.ndarray:
        """All values, as select() gives them one by one."""
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n].astype(np.uint64)
        high = places - np.arange(self.n, dtype=np.uint64)
        low = np.unpackbits(self.low, count=self.n * self.low_bits, bitorder="little").reshape(self.n, self.low_bits)
        return (high << np.uint64(self.low_bits)) | (low.astype(np.uint64) @ (np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64)))


def image(ids: bytes, width: int, doc_ids: np.ndarray, ends: np.ndarray) -> bytes:
    """The binary image of a segment."""
    ef = EliasFano.of(ends)
    head = HEAD.pack(MAGIC, 1, width, ef.low_bits, 0, len(doc_ids), len(ids) // width)
    return b"".join([head, ids, np.asarray(doc_ids, "<i8").tobytes(), ef.low.tobytes(), ef.high.tobytes()])


def opened(raw: bytes) -> tuple[np.ndarray, np.ndarray, EliasFano]:
    """ids, doc_ids and boundaries of a segment's image."""
    magic, version, width, bits, _, docs, count = HEAD.unpack_from(raw)
    if magic != MAGIC or version != 1:
        raise ValueError("not a token segment")
    at = HEAD.size
    ids = np.frombuffer(raw, f"<u{width}", count, at)
    at += count * width
    doc_ids = np.frombuffer(raw, "<i8", docs, at)
    at += 8 * docs
    low = np.frombuffer(raw, np.uint8, -(-docs * bits // 8), at)
    return ids, doc_ids, EliasFano(docs, bits, low, np.frombuffer(raw, np.uint8, offset=at + len(low)))


def gathered(flat: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the stretches that ``flat`` is made of those at ``codes``, one after another, and their lengths."""
    n = lengths[codes]
    starts, ends = np.cumsum(lengths) - lengths, np.cumsum(n)
    return flat[np.arange(n.sum()) + np.repeat(starts[codes] - ends + n, n)], n


class Words:
    """The ids of strings without white space, as bytes; those not kept are encoded many at a time.

    Two generations of about ``room`` strings each are kept, so frequent ones stay. Words of PLAIN letters go to the
    tokenizer's model, in the form that its normaliser and pre-tokenizer give them and side by side: a word's last id is
    one that ends words. All others go through the whole tokenizer.
    """

    def __init__(self, tokenizer, dtype: str, room: int, side_by_side: bool = True):
        self.tokenizer, self.dtype, self.room = tokenizer, dtype, room
        self.kept, self.old = {}, {}
        self.bytes_of = self._byte_letters() if side_by_side else None
        if self.bytes_of:
            from tokenizers import Tokenizer, pre_tokenizers

            self.bare = Tokenizer(tokenizer.model)
            self.bare.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
            vocab = tokenizer.get_vocab(with_added_tokens=False)
            self.closes = np.zeros(max(vocab.values()) + 1, bool)
            self.closes[[i for token, i in vocab.items() if token.endswith(tokenizer.model.end_of_word_suffix)]] = True

    def _byte_letters(self) -> str | None:
        """Each byte of plain letters as the pre-tokenizer writes it; None if the tokenizer isn't of the kind that this fits."""
        steps = self.tokenizer.pre_tokenizer
        table = {ord(" "): " "}
        for c in PLAIN:
            got, raw = steps.pre_tokenize_str(c) if steps else [], c.encode()
            if len(got) != 1 or len(got[0][0]) != len(raw) or any(table.setdefault(*x) != x[1] for x in zip(raw, got[0][0], strict=True)):
                return None
        return "".join(table.get(i, "\ufffe") for i in range(256)) if getattr(self.tokenizer.model, "end_of_word_suffix", None) else None

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _side_by_side(self, words: list[str]) -> list[bytes]:
        """The ids of plain words."""
        out = []
        for at in range(0, len(words), WORDS):
            some = words[at : at + WORDS]
            line = codecs.charmap_decode(" ".join(some).encode(), "strict", self.bytes_of)[0]
            ids = np.array(self.bare.encode_batch_fast([line], add_special_tokens=False)[0].ids, np.int64)
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) != len(some) or ends[-1] != len(ids):
                out += map(self.whole, some)
                continue
            raw, ends = ids.astype(self.dtype).tobytes(), (ends * np.dtype(self.dtype).itemsize).tolist()
            out += [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        return out

    def ids(self, strings: pa.Array) -> list[bytes]:
        """The ids of each of the strings, which are distinct."""
        words = strings.to_numpy(zero_copy_only=False).tolist()
        got = list(map(self.kept.get, words))
        gaps = [i for i, ids in enumerate(got) if ids is None]
        new = []
        for i in gaps:
            got[i] = self.old.get(words[i])
            if got[i] is None:
                new.append(i)
        plain = pc.match_substring_regex(strings.take(pa.array(new, pa.int64())), _PLAIN).to_pylist() if self.bytes_of else [False] * len(new)
        side = list(compress(new, plain))
        for i, ids in zip(side, self._side_by_side([words[i] for i in side]), strict=True):
            got[i] = ids
        for i in new:
            if got[i] is None:
                got[i] = self.whole(words[i])
        if len(self.kept) + len(gaps) > self.room:
            self.old, self.kept = self.kept, {}
        self.kept.update((words[i], got[i]) for i in gaps)
        return got


class Encoder:
    """Ids of texts by a tokenizer that drops white space: the ids of a text are those of its pieces, one by one.

    A piece is a run without white space. Those of letters with marks around them at most are cut into the marks and the
    word, in lower case. Each distinct string of a slice of texts is looked up once; its ids are then copied to all its
    places. Where the tokenizer keeps white space (or a text has some that only the split takes for it), texts are
    encoded whole.
    """

    def __init__(self, path: str, width: int, cache: int = CACHE):
        from tokenizers import Tokenizer

        self.tokenizer, self.dtype = Tokenizer.from_file(path), f"<u{width}"
        self.words = Words(self.tokenizer, self.dtype, cache)
        self.by_piece = self._drops_space()
        if self.words.bytes_of and not (self.by_piece and self._cuts_marks()):
            self.words = Words(self.tokenizer, self.dtype, cache, side_by_side=False)

    def _drops_space(self) -> bool:
        ids = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        probe = ["a b", "a  b\n\tc", "1 2", ". .", "é è", "a 's", "' s"]
        return all(ids(x) == sum((ids(p) for p in x.split()), []) for x in probe)

    def _cuts_marks(self) -> bool:
        probe = ["étéß", "strassen", "Über,", "(Niño)", "a!!", "zz***", "\"word\"", "x", "THE.", "ÀB;", *LETTERS]
        return list(self._slice(pa.array(probe))) == [self.words.whole(x) for x in probe]

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, one after another, and how many each has."""
        parts = [pieces]
        if self.words.bytes_of:
            before, word, after = pc.extract_regex(pieces, _SIMPLE).flatten()
            parts = [pc.fill_null(before, ""), pc.coalesce(pc.utf8_lower(word), pieces), pc.fill_null(after, "")]
        strings = pa.concat_arrays(parts).dictionary_encode()
        ids = self.words.ids(strings.dictionary)
        flat = np.frombuffer(b"".join(ids), self.dtype)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // flat.itemsize
        flat, n = gathered(flat, lengths, strings.indices.to_numpy().reshape(len(parts), -1).T.ravel())
        return flat, n.reshape(-1, len(parts)).sum(axis=1)

    def _slice(self, texts: pa.Array) -> Iterator[bytes]:
        whole = pc.match_substring_regex(texts, _SPLIT_ONLY)
        split = pc.utf8_split_whitespace(pc.if_else(whole, "", texts))
        pieces = split.flatten().dictionary_encode()
        ids, n = gathered(*self._pieces(pieces.dictionary), pieces.indices.to_numpy())
        ends = np.append(0, np.cumsum(n))[split.offsets.to_numpy()].tolist()
        for i, alone in enumerate(whole.to_pylist()):
            yield self.words.whole(texts[i].as_py()) if alone else ids[ends[i] : ends[i + 1]].tobytes()

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text (none of them null)."""
        if not self.by_piece:
            yield from (self.words.whole(t.as_py()) for t in texts)
            return
        number = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64) // SLICE
        cuts = np.flatnonzero(np.diff(number)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(texts)], strict=True):
            yield from self._slice(texts[a:b])


def write_tokens(docs: DataFrame, tokenizer: str, out: str, end_id: int = END, segment_ids: int = SEGMENT_IDS, cache: int = CACHE) -> None:
    """Writes docs (doc_id, text) in ascending doc_id order (null last, then by text) to the folder ``out``.

    Null texts are empty: their only id is the end. Repeated rows are documents of their own. Other columns are ignored.
    """
    from tokenizers import Tokenizer

    width = 2 if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a worker has one core
        encoder, stop = Encoder(tokenizer, width, cache), end_id.to_bytes(width, "little")
        part, number = TaskContext.get().partitionId(), 0
        ids: list[bytes] = []
        names: list[int] = []
        total, ends = 0, []

        def closed() -> pa.RecordBatch:
            raw = image(b"".join(ids), width, np.array(names), np.array(ends))
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "segment": pa.array([number], pa.int32()), "n_ids": [total], "image": pa.array([raw], pa.binary())})

        for batch in batches:
            for name, got in zip(batch["doc_id"].to_pylist(), encoder.encode(batch["text"]), strict=True):
                ids.append(got + stop)
                total += len(ids[-1]) // width
                names.append(name)
                ends.append(total)
                if total >= segment_ids:
                    yield closed()
                    number, total = number + 1, 0
                    ids, names, ends = [], [], []
        if names:
            yield closed()

    text_batches(docs.sparkSession)
    ordered = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(tidy(f), "part int, segment int, n_ids long, image binary").write.mode("overwrite").parquet(out)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids, from the folder's files."""
    segments = spark.read.parquet(path)
    before = totals_before(segments.select("part", "n_ids"), "part", "n_ids")
    within = spark.read.parquet(path).select("part", "segment", "n_ids")
    within = within.withColumn("inside", F.sum("n_ids").over(Window.partitionBy("part").orderBy("segment")) - F.col("n_ids"))
    places = within.join(F.broadcast(before), "part").select("part", "segment", (F.col("before") + F.col("inside")).alias("base"))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, segment, raw in zip(batch["part"], batch["segment"], batch["image"], strict=True):
                ids, names, ends = opened(raw.as_py())
                ends = ends.values().astype(np.int64)
                starts = np.append(0, ends[:-1])
                wide = ids.astype("<u4")
                crc = [zlib.crc32(wide[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(names)
                columns = {"part": pa.array([part.as_py()] * n, pa.int32()), "segment": pa.array([segment.as_py()] * n, pa.int32()), "doc_id": names, "start": starts, "n_tokens": ends - starts, "ids_crc32": pa.array(crc, pa.int64())}
                if with_ids:
                    columns["ids"] = pa.array([wide[a:b].tolist() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(columns)

    schema = "part int, segment int, doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    rows = segments.select("part", "segment", "image").mapInArrow(tidy(f), schema).join(places, ["part", "segment"])
    doc_id = F.when(F.col("doc_id") < (1 << 63) - 1, F.col("doc_id")).alias("doc_id")
    return rows.select(doc_id, (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def tokenised(spark: SparkSession, docs: DataFrame, tokenizer: str, out: str | None = None, cache: int = CACHE) -> DataFrame:
    """Writes docs to ``out`` (a new folder in the shared one by default) and reads the files back."""
    out = out or f"{shared_folder(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, tokenizer, out, cache=cache)
    return read_tokens(spark, out)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5(spark, sf_dir: str) -> DataFrame:
    return tokenised(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
