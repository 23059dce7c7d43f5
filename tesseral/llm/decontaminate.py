"""Benchmark decontamination: windows of benchmark words, found in every text by a broadcast set of window hashes.

Words are runs of digits, letters and non-ASCII characters after lower-casing A-Z. A window is 10 consecutive words of an
item, or the whole item if it has fewer. The hash set of all windows goes to the executors as one broadcast variable if
the windows number at most ``max_windows``; a larger benchmark is cut into blocks of that size, each of which scans the
texts once, and the spans found are joined. Tasks hash the words of whole Arrow batches in numpy, look each window up
in the sorted set, and compare the words of every hit with the item's own before it counts. A hit carries its place alone; the items of a
document's windows are gathered once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesseral.llm.words import ALNUM, text_slices, windows, word_spans

#: Bound of a broadcast set of windows: some 50 MB with their words.
MAX_WINDOWS = 500_000
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
SPANS = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("n", T.IntegerType())]))
ITEMS = T.ArrayType(T.StringType())
#: Columns that find_spans adds.
ADDED = ["n_words", "spans", "items"]


def _gram(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    return b" ".join([data[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]).translate(_LOWER)


class WindowSet:
    """Windows as flat arrays, by rising hash: their words, for verification, and the numbers of the items that have them."""

    def __init__(self, grams: dict[bytes, list[int]], hashes: list[int], names: list[str], lengths: set[int]):
        order = np.argsort(np.array(hashes, np.uint64), kind="stable")
        texts = list(grams)
        self.lengths, self.names = sorted(lengths), names
        self.hashes = np.array(hashes, np.uint64)[order]
        self.text = b"".join(texts[i] for i in order.tolist())
        self.text_at = np.cumsum([0, *[len(texts[i]) for i in order.tolist()]])
        lists = list(grams.values())
        self.item_at = np.cumsum([0, *[len(lists[i]) for i in order.tolist()]])
        self.items = np.array([k for i in order.tolist() for k in lists[i]], np.int32)
        self.mask = np.zeros(1 << 20, bool)
        self.mask[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        """Where a hash is one of a window's."""
        near = np.flatnonzero(self.mask[(hashes >> np.uint64(44)).astype(np.int64)])
        if not len(near):
            return near
        at = np.minimum(np.searchsorted(self.hashes, hashes[near]), len(self.hashes) - 1)
        return near[self.hashes[at] == hashes[near]]

    def window(self, key: int, gram: bytes) -> int:
        """The window with these words, -1 for none."""
        i = int(np.searchsorted(self.hashes, np.uint64(key)))
        while i < len(self.hashes) and int(self.hashes[i]) == key:
            if self.text[self.text_at[i] : self.text_at[i + 1]] == gram:
                return i
            i += 1
        return -1

    def items_of(self, windows: set[int]) -> list[str]:
        """The items that have any of the windows, sorted."""
        parts = [self.items[self.item_at[i] : self.item_at[i + 1]] for i in windows]
        return sorted({self.names[k] for k in np.unique(np.concatenate(parts)).tolist()}) if parts else []


def window_sets(items: Iterator[tuple[str, str]], n: int, max_windows: int) -> Iterator[WindowSet]:
    """The items' windows, in sets of at most max_windows (the last item may overrun by its own)."""
    grams: dict[bytes, list[int]] = {}
    hashes: list[int] = []
    names: list[str] = []
    lengths: set[int] = set()
    count = 0
    for item, text in items:
        data = np.frombuffer((text or "").encode(), np.uint8)
        starts, ends, words = word_spans(data, np.array([0, len(data)]), ALNUM)
        if not len(starts):
            continue
        length, mine = min(n, len(starts)), len(names)
        names.append(item)
        for i, h in enumerate(windows(words, length).tolist()):
            gram = _gram(data, starts[i : i + length], ends[i : i + length])
            have = grams.get(gram)
            if have is None:
                grams[gram] = [mine]
                hashes.append(h)
            elif have[-1] != mine:  # items come one after another
                have.append(mine)
            count += 1
        lengths.add(length)
        if count >= max_windows:
            yield WindowSet(grams, hashes, names, lengths)
            grams, hashes, names, lengths, count = {}, [], [], set(), 0
    if count:
        yield WindowSet(grams, hashes, names, lengths)


def _scan(known: WindowSet, column: pa.Array) -> tuple[list[int], list[list[dict]], list[list[str]]]:
    """For each text its number of words, the verified occurrences of windows, and the items that have them."""
    sizes, spans, items = [], [], []
    for first, last, data, offsets in text_slices(column):
        starts, ends, hashes = word_spans(data, offsets, ALNUM)
        row_at = np.searchsorted(starts, offsets)
        found: list[list[dict]] = [[] for _ in range(last - first)]
        met: dict[int, set[int]] = {}
        for length in known.lengths:
            grams = windows(hashes, length)
            for i in known.hits(grams).tolist():
                row = int(np.searchsorted(row_at, i, "right")) - 1
                if i + length > row_at[row + 1]:
                    continue  # it runs into the next text
                window = known.window(int(grams[i]), _gram(data, starts[i : i + length], ends[i : i + length]))
                if window >= 0:
                    found[row].append({"first": i - int(row_at[row]), "n": length})
                    met.setdefault(row, set()).add(window)
        sizes += np.diff(row_at).tolist()
        spans += found
        items += [known.items_of(met.get(row, set())) for row in range(last - first)]
    return sizes, spans, items


def find_spans(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", n: int = 10, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """All columns of docs with n_words (int), spans, an array of (first word, number of words) of all occurrences of windows, and items, the
    item ids that have any of them, sorted, each once per document, however many windows or documents share them.

    The three names replace columns of the same name. An empty table gives an empty table; long texts are read whole, in pieces. Null and wordless texts have no words and no spans; a null item id
    counts as the empty string; repeated items and rows count as they come; without windows nothing is hit.
    The benchmark's rows are read one after another on the driver, and only max_windows windows are held at a time.
    """
    spark = docs.sparkSession
    keep = [c for c in docs.columns if c not in ADDED]
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("n_words", T.IntegerType()), T.StructField("spans", SPANS), T.StructField("items", ITEMS)])
    arrow_spans, arrow_items = pa.list_(pa.struct([("first", pa.int32()), ("n", pa.int32())])), pa.list_(pa.string())
    rows = ((r[0] or "", r[1] or "") for r in benchmark.select(F.col(item).cast("string"), item_text).toLocalIterator())
    out = None
    for known in window_sets(rows, n, max_windows):
        shared = spark.sparkContext.broadcast(known)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sizes, spans, items = _scan(shared.value, batch.column(batch.schema.get_field_index(text)))
                columns = [batch.column(batch.schema.get_field_index(c)) for c in keep] + [pa.array(sizes, pa.int32()), pa.array(spans, arrow_spans), pa.array(items, arrow_items)]
                yield pa.RecordBatch.from_arrays(columns, [*keep, *ADDED])

        if out is None:
            out = docs.select(*{c: 0 for c in [*keep, text]}).mapInArrow(scan, schema)
        else:  # a further block of a large benchmark: the spans so far are carried along
            before = out.withColumnsRenamed({"spans": "_spans", "items": "_items"})
            held = before.columns

            def more(batches: Iterator[pa.RecordBatch], shared=shared, held=held) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    _, spans, items = _scan(shared.value, batch.column(batch.schema.get_field_index(text)))
                    columns = [batch.column(i) for i in range(batch.num_columns)] + [pa.array(spans, arrow_spans), pa.array(items, arrow_items)]
                    yield pa.RecordBatch.from_arrays(columns, [*held, "_more", "_others"])

            both = before.mapInArrow(more, T.StructType([*before.schema.fields, T.StructField("_more", SPANS), T.StructField("_others", ITEMS)]))
            out = both.select(*keep, "n_words", F.array_distinct(F.concat("_spans", "_more")).alias("spans"), F.array_sort(F.array_union("_items", "_others")).alias("items"))
    if out is None:
        words = F.regexp_count(F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"))
        out = docs.select(*keep, words.cast("int").alias("n_words"), F.array().cast(SPANS).alias("spans"), F.array().cast(ITEMS).alias("items"))
    return out


def hit_words(spans: F.Column) -> F.Column:
    """Number of different words inside the spans."""
    return F.size(F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["first"], s["first"] + s["n"] - 1)))))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, max_share: float = 0.0, **names) -> DataFrame:
    """The rows of docs whose share of hit words is at most max_share; with 0 every document with a hit goes."""
    found = find_spans(docs, benchmark, **names)
    clean = hit_words(F.col("spans")) <= F.lit(float(max_share)) * F.col("n_words")
    return found.filter(clean).select(*docs.columns) if not set(ADDED) & set(docs.columns) else _restore(docs, benchmark, max_share, names)


def _restore(docs: DataFrame, benchmark: DataFrame, max_share: float, names: dict) -> DataFrame:
    """decontaminate() for docs that have columns named as find_spans names its own: they travel under other names."""
    away = {c: f"_own_{c}" for c in ADDED if c in docs.columns}
    clean = decontaminate(docs.withColumnsRenamed(away), benchmark, max_share=max_share, **names)
    return clean.withColumnsRenamed({v: k for k, v in away.items()}).select(*docs.columns)


def cut_spans(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", **names) -> DataFrame:
    """docs with every hit word removed from its text, the rest left as it is (the span-removing form)."""
    keep = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            spans = batch.column(batch.schema.get_field_index("_spans")).to_pylist()
            out = [_without(t, s) if s else t for t, s in zip(texts, spans, strict=True)]
            columns = [pa.array(out, pa.string()) if c == text else batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays(columns, keep)

    found = find_spans(docs.withColumnsRenamed({c: f"_own_{c}" for c in ADDED}), benchmark, text=text, **names)
    found = found.withColumnRenamed("spans", "_spans").drop("n_words", "items").withColumnsRenamed({f"_own_{c}": c for c in ADDED})
    return found.mapInArrow(cut, docs.schema)


def _without(text: str, spans: list[dict]) -> str:
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = word_spans(data, np.array([0, len(data)]), ALNUM)
    keep = np.ones(len(data), bool)
    for s in spans:
        for i in range(s["first"], s["first"] + s["n"]):
            keep[starts[i] : ends[i]] = False
    return data[keep].tobytes().decode()
