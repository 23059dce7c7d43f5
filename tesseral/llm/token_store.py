"""Token-id output: whole texts as ids of a public byte-level BPE vocabulary, in Parquet list columns.

Documents are range-partitioned by id, so that files hold ascending ids; each task encodes its texts and appends the end
id. The files hold, per document, doc_id, part, start_in_part, n_tokens and the list column ids, in dictionary
encoding, with row groups of a set size, limited data pages and page indexes. Readers that need only the small columns, or a range of
documents, don't read the other pages.

Encoding works on the vocabulary's pre-tokens: their borders are found in numpy (the pattern of the tokenizer
file, written as rules on character classes), the tokenizers library's model encodes each distinct pre-token once for a task's texts, and the
ids of the texts are gathered from those; equal pre-tokens are told by their bytes. The result is the library's own encoding of the whole text: texts are cut at the added tokens of
the tokenizer file, or, with ``literal``, special ones among them are text like any other (encode_special_tokens of the library).
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesseral.llm.words import U, equal_words, text_slices, word_hashes
from tesseral.llm.work import Scratch

END_ID = 2
#: Most bytes of text that a file is meant to hold.
TEXT_BYTES = 64 << 20
#: Bytes of text that are encoded at once; a longer text is one piece.
SLICE = 1 << 19
#: Distinct pre-tokens whose ids a task remembers, and then starts anew; those that are kept apart until they join the rest.
REMEMBERED, RECENT = 500_000, 60_000
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: Writer settings: dictionary-encoded ids, 32 MB row groups, pages of at most 64 KB with their indexes.
LAYOUT = {"parquet.block.size": str(32 << 20), "parquet.page.size": str(64 << 10), "parquet.enable.dictionary": "true", "compression": "zstd"}
SCHEMA = "doc_id long, part int, start_in_part long, n_tokens int, ids array<int>"


def _classes() -> np.ndarray:
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        out[c] = LETTER if kind == "L" else NUMBER if kind == "N" else SPACE if kind == "Z" and c != 0x200B else OTHER
    out[[*range(0x09, 0x0E), 0x85]] = SPACE
    return out


_KEPT: dict = {}


def pre_tokens(codes: np.ndarray, text_at: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin in the code points of texts that lie one after another.

    The pattern's rules: runs of letters, numbers or other signs, each with one blank before it; an apostrophe with
    s, t, re, ve, m, ll or d that begins a run is a pre-token; of white space before a text goes on, the last character stands alone
    unless it is the blank of the next run.
    """
    n = len(codes)
    if n == 0:
        return np.zeros(0, np.int64)
    if "classes" not in _KEPT:
        _KEPT["classes"] = _classes()
    kind = _KEPT["classes"][codes]
    fresh = np.zeros(n + 1, bool)
    fresh[text_at] = True  # a text begins, or all have ended
    change = np.ones(n + 1, bool)
    change[1:n] = kind[1:] != kind[:-1]
    change |= fresh
    begin = change[:n].copy()
    space = kind == SPACE
    last = space & change[1:] & ~fresh[1:]  # the last white space of a run that goes on with another class
    begin[last] = True
    joins = np.flatnonzero(last & (codes == 32)) + 1
    begin[joins] = False
    # contractions: an apostrophe at the beginning of a pre-token
    quote = np.flatnonzero((codes == 39) & begin)
    if len(quote):
        room = np.append(codes, np.zeros(2, codes.dtype))
        inside1 = ~fresh[np.minimum(quote + 1, n)]
        inside2 = inside1 & ~fresh[np.minimum(quote + 2, n)]
        one, two = room[quote + 1], room[quote + 2]
        short = inside1 & np.isin(one, [ord(c) for c in "stmd"])
        long = inside2 & ~short & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
        begin[quote[short] + 1] = False
        begin[quote[long] + 1] = False
        over = np.concatenate((quote[short] + 2, quote[long] + 3))
        # what follows begins a pre-token of its own, unless it is a blank run's business
        over = over[over < n]
        begin[over[~space[over]]] = True
        begin[over[space[over]]] = True
    return np.flatnonzero(begin)


def _signs() -> dict[int, int]:
    """The vocabulary's character for each byte: printable ones stand for themselves, the others follow from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


class Encoder:
    """The tokenizers library behind a memory of distinct pre-tokens.

    Pre-tokens are found by a hash of their bytes, and count as found only if the bytes agree. Only tokenizer files are taken whose
    pre-tokenization this module knows: byte-level BPE with the pattern of ``pre_tokens`` and nothing before it.
    """

    def __init__(self, file: str, literal: bool = True):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(file)
        parts = json.loads(tokenizer.to_str())
        before, model = parts["pre_tokenizer"] or {}, parts["model"]
        if parts["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or model.get("type", "BPE") != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            raise ValueError("the tokenizer file must be byte-level BPE with the usual pattern, without normalizer")
        self.model, self.signs = tokenizer.model, _signs()
        added = {t.content: (i, t) for i, t in tokenizer.get_added_tokens_decoder().items() if not (literal and t.special)}
        if any(t.lstrip or t.rstrip or t.single_word for _, t in added.values()):
            raise ValueError("added tokens that depend on what stands beside them are not supported")
        self.added = {content: i for content, (i, _) in added.items()}
        self.cuts = re.compile("(" + "|".join(re.escape(c) for c in sorted(added, key=len, reverse=True)) + ")") if added else None
        self._forget()

    def _forget(self) -> None:
        none = (np.zeros(0, U), *(np.zeros(0, np.int64) for _ in range(4)))
        #: Sorted hashes; where their ids begin, and how many; where their bytes begin, and how many: the bulk, and the recent ones.
        self.tables = [none, none]
        self.ids, self.bytes = np.zeros(0, np.int32), np.zeros(0, np.uint8)

    def _find(self, hashes: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the ids of each pre-token begin, -1 for unknown ones, how many they are, and whether another one has its hash."""
        first, count, taken = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        for known, begin, many, at_byte, size in self.tables:
            if len(known):
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                hit = np.flatnonzero(known[at] == hashes)
                at = at[hit]
                same = (size[at] == length[hit]) & equal_words(data, start[hit], self.bytes, at_byte[at], np.minimum(size[at], length[hit]))
                first[hit[same]], count[hit[same]], taken[hit[~same]] = begin[at[same]], many[at[same]], True
        return first, count, taken

    def _learn(self, hashes: np.ndarray, pieces: list[bytes], ids: np.ndarray, count: np.ndarray) -> None:
        ends = lambda n: np.concatenate((np.zeros(1, np.int64), np.cumsum(n)[:-1]))
        size = np.array([len(p) for p in pieces], np.int64)
        fresh = (hashes, ends(count) + len(self.ids), count, ends(size) + len(self.bytes), size)
        self.ids = np.concatenate((self.ids, ids))
        self.bytes = np.concatenate((self.bytes, np.frombuffer(b"".join(pieces), np.uint8)))
        place = np.searchsorted(self.tables[1][0], hashes)
        self.tables[1] = tuple(np.insert(t, place, v) for t, v in zip(self.tables[1], fresh, strict=True))
        if len(self.tables[1][0]) > RECENT:
            both = [np.concatenate(t) for t in zip(*self.tables, strict=True)]
            order = np.argsort(both[0], kind="stable")
            kept = self.ids, self.bytes
            self._forget()
            self.tables[0], (self.ids, self.bytes) = tuple(t[order] for t in both), kept

    def _library(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens one after another, and how many each has, by the library's own merges."""
        signs = b"".join(pieces).decode("latin-1").translate(self.signs)
        upto = np.cumsum([0, *map(len, pieces)]).tolist()
        found = [[t.id for t in self.model.tokenize(signs[a:b])] for a, b in zip(upto[:-1], upto[1:], strict=True)]
        return np.array([i for ids in found for i in ids], np.int32), np.array([len(ids) for ids in found], np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has."""
        if self.cuts is None or not any(c in t for c in self.added for t in texts):
            return self._encode(texts)
        split = [self.cuts.split(t) for t in texts]  # text, added token, text, added token ... text
        ids, count = self._encode([part for parts in split for part in parts[::2]])
        upto = np.cumsum(count)
        last = np.cumsum([len(parts) // 2 + 1 for parts in split])  # a text's last part has no added token after it
        between = np.ones(len(count), bool)
        between[last - 1] = False
        tokens = [self.added[t] for parts in split for t in parts[1::2]]
        whole = np.diff(np.concatenate((np.zeros(1, np.int64), upto[last - 1])))
        return np.insert(ids, upto[between], tokens).astype(np.int32), whole + np.array([len(parts) // 2 for parts in split])

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        whole = "".join(texts)
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        data = np.frombuffer(whole.encode("utf-8", "surrogatepass"), np.uint8)
        text_at = np.concatenate((np.zeros(1, np.int64), np.cumsum([len(t) for t in texts], dtype=np.int64)))
        starts = pre_tokens(codes, text_at)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        begin = starts
        if len(data) > len(codes):  # places of code points to places of bytes
            begin = np.concatenate((np.zeros(1, np.int64), np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF))))[starts]
        length = np.diff(np.append(begin, len(data)))
        all_hashes = word_hashes(data, begin, begin + length)
        hashes, where, back = np.unique(all_hashes, return_index=True, return_inverse=True)
        one = where[back]
        odd = (length != length[one]) | ~equal_words(data, begin, data, begin[one], np.minimum(length, length[one]))
        if odd.any():  # another pre-token of the same hash in these texts: each occurrence for itself
            hashes, where = np.concatenate((hashes, all_hashes[odd])), np.concatenate((where, np.flatnonzero(odd)))
            back = back.copy()
            back[odd] = np.arange(len(hashes) - odd.sum(), len(hashes))
        if sum(len(t[0]) for t in self.tables) + len(hashes) > REMEMBERED:
            self._forget()
        first, count, taken = self._find(hashes, data, begin[where], length[where])
        new = np.flatnonzero(first < 0)
        if len(new):
            pieces = [data[a : a + n].tobytes() for a, n in zip(begin[where[new]].tolist(), length[where[new]].tolist(), strict=True)]
            ids, many = self._library(pieces)
            upto = np.cumsum(many)
            first[new], count[new] = upto - many + len(self.ids), many
            if taken.any() or odd.any():  # what shares a hash is not remembered
                self.ids = np.concatenate((self.ids, ids))
            else:
                self._learn(hashes[new], pieces, ids, many)
        each = count[back]
        total = np.concatenate((np.zeros(1, np.int64), np.cumsum(each)))
        source = np.repeat(first[back] - total[:-1], each) + np.arange(total[-1])
        piece_at = np.searchsorted(starts, text_at)
        return self.ids[source], np.diff(total[piece_at])


def encoder(file: str, literal: bool = True) -> Encoder:
    """One encoder per worker process, file and way with special tokens."""
    if (file, literal) not in _KEPT:
        _KEPT[file, literal] = Encoder(file, literal)
    return _KEPT[file, literal]


def _with_end(ids: np.ndarray, count: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    upto = np.concatenate((np.zeros(1, np.int64), np.cumsum(count)))
    return np.insert(ids, upto[1:], end_id).astype(np.int32), upto + np.arange(len(upto))


def _pieces(texts: pa.Array) -> Iterator[list[str]]:
    """The texts of a column, some SLICE bytes at a time."""
    for first, last, _, _ in text_slices(texts, SLICE):
        yield texts.slice(first, last - first).to_pylist()


def write_tokens(docs: DataFrame, path: str, tokenizer_file: str, *, key: str = "doc_id", text: str = "text", end_id: int = END_ID, partitions: int | None = None, literal: bool = True) -> None:
    """Writes the ids of docs' texts to path, in ascending id order (null ids first; rows that repeat an id by their text).

    A null text counts as empty and has the end id alone. With ``literal`` the special tokens' texts are plain text, else they give their ids. Other columns are not read; an empty table writes empty files.
    """
    spark = docs.sparkSession
    ordered = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if partitions is None:
        size = ordered.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TEXT_BYTES))
    ordered = ordered.repartitionByRange(partitions, "doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start, known = TaskContext.get().partitionId(), 0, encoder(tokenizer_file, literal)
        for batch in batches:
            row, texts = 0, batch.column(1)
            for piece in _pieces(texts):
                ids, count = known.encode(piece)
                ids, at = _with_end(ids, count, end_id)
                count = np.diff(at)
                keys = batch.column(0).slice(row, len(piece))
                row += len(piece)
                starts = start + at[:-1]
                start += int(at[-1])
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([keys, pa.array(np.full(len(piece), part, np.int32)), pa.array(starts), pa.array(count.astype(np.int32)), lists], ["doc_id", "part", "start_in_part", "n_tokens", "ids"])

    ordered.mapInArrow(encode, SCHEMA).write.mode("overwrite").options(**LAYOUT).parquet(path)


def read_tokens(spark, path: str) -> DataFrame:
    """The files' rows with start, the number of ids of all documents before each. Only the columns in use are read; the
    windows run over one row per part."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("_sum"))
    before = F.sum("_sum").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(F.col("part").alias("_part"), F.coalesce(before, F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(parts), rows["part"] == F.col("_part")).select("doc_id", (F.col("_before") + F.col("start_in_part")).alias("start"), "n_tokens", "ids")


def with_checksums(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of the ids as little-endian 32-bit integers), from rows as they are stored."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            ids = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            at = lists.offsets.to_numpy().tolist()
            sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2).cast(pa.int64()), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(check, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokens_of(docs: DataFrame, tokenizer_file: str, **options) -> DataFrame:
    """Writes docs' ids to the shared folder, reads the files back and returns with_checksums() of them."""
    scratch = Scratch(docs.sparkSession, "tokens")
    write_tokens(docs, scratch.path("ids"), tokenizer_file, **options)
    return with_checksums(read_tokens(docs.sparkSession, scratch.path("ids")))
