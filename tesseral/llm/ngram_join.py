"""N-gram Jaccard join by PartEnum signatures: exact linking of texts whose shingle sets have a similarity of t or more.

A text's set holds its distinct shingles of five words (lower-cased A-Z, split at ASCII white space); a shorter text is
one shingle. Texts of the same words (a 128-bit digest of the word sequence) become one node first. Sets are dealt to size bands [L, 2L); a set
of at least t * 2L also takes part in the next band, so that two sets that can be similar meet in one band.

Two sets of sizes a, b with Jaccard >= t differ in at most d = (a + b)(1 - t)/(1 + t) shingles. In a band the domain of
shingles is partitioned by hash, and subsets of the parts are enumerated; a signature is the hash of (band, subset, shingles of the set
in it), for subsets that are not empty:

* Below L = 128 the domain has blocks of three parts, and the subsets are the three pairs of parts of each block
  (n2 = 3, k2 = 1). At most d / 2 blocks differ in two shingles or more; in any other block a pair of parts is equal. A block is full if two
  of its parts hold shingles: there the equal pair is not empty. So a set with f > d / 2 full blocks shares a signature
  with every similar set, and 2f - d signatures at least (3f - 2d if d <= f).
* From there on the subsets are single parts (n2 = k2 + 1), as pairs would cost half as many signatures again for large d. A set
  with p > d parts that hold shingles shares p - d signatures at least.

A set that is short of full blocks or parts also gives the finest partition's signatures, one per shingle. Of two similar
sets either one is not short and vouches for a common signature, or both are and share one of these.

Signatures that many sets hold, from passages that many texts share, need not all be compared: a set that shares o signatures
with any partner may do without its o - 1 most frequent ones, as the rarest common one is not among those.

A group of m sets with one signature is not expanded into pairs: each is compared with the group's hub, the set that holds
most frequent signatures (a star). Groups that still hold several components are few. With an infrequent signature (at most
FREQUENT sets) they are compared pair by pair. Those with frequent ones are gathered into clusters, sets of one space that
such groups connect, each cluster with one hub h. With D(x) the symmetric difference of x and h, similar sets
x and y have D(x) and D(y) that share (|D(x)| + |D(y)| - (|x| + |y|) / 7) / 2 shingles or more, as 1 / 7 is (1 - t) / (1 + t); so one
of the rarest shingles of both, so many as leave fewer than they must share. Edits are rare: a large group of copies that are too far apart
makes few pairs, and each set of a cluster is compared with one hub only. Every link is confirmed on the words of the two whole texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesseral.llm.components import connected
from tesseral.llm.words import SPACED, U, mix, text_slices, windows, word_spans
from tesseral.llm.work import Scratch, broadcast_if_small

WORDS = 5
#: Similarity in hundredths: |A and B| * 100 >= SIMILARITY * |A or B|.
SIMILARITY = 75
#: A signature is frequent if more sets hold it.
FREQUENT = 16
#: Bands from here on have single parts as subsets, those below pairs of parts.
PAIRS_BELOW = 128
#: The space of the finest partition; those of bands are log2 of L.
FINEST = 99
#: A signature that more sets of a slice of SLICE bytes hold is dealt to SALTS groups from then on.
HEAVY, SLICE, SALTS = 64, 4 << 20, 64
#: Signatures are sorted in buckets by their hash, one for so many shingles of the table; a bucket names a signature by 32 bits.
BUCKET, LEAST_BUCKETS, MOST_BUCKETS = 1 << 19, 128, 65_535
#: Sets that a task remembers having given the signatures of.
REMEMBERED = 200_000
#: Parts that a hub's comparisons are dealt to.
HUB_SALTS = 32
#: A-Z to a-z; bytes.split() then cuts at the separators of SPACED.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row, sorted, one row after another, and where each row begins."""
    starts, _, hashes = word_spans(data, offsets, SPACED)
    row_at = np.searchsorted(starts, offsets)
    grams = windows(hashes, n)
    rows = len(offsets) - 1
    parts = []
    for r in range(rows):
        a, b = row_at[r], row_at[r + 1]
        parts.append(grams[a : b - n + 1].copy() if b - a >= n else windows(hashes[a:b], b - a)[:1] if b > a else grams[:0])
        parts[-1].sort()
    sets = np.concatenate(parts) if parts else np.zeros(0, U)
    lens = np.array([len(p) for p in parts], np.int64)
    row = np.repeat(np.arange(rows), lens)
    first = np.ones(len(sets), bool)
    first[1:] = (sets[1:] != sets[:-1]) | (row[1:] != row[:-1])
    sets, row = sets[first], row[first]
    return sets, np.searchsorted(row, np.arange(rows + 1))


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums, modulo 2**64, of values[at[i]:at[i+1]]."""
    total = np.concatenate((np.zeros(1, U), np.cumsum(values)))
    return total[at[1:]] - total[at[:-1]]


def word_digests(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit halves of a digest of each row's lower-cased words, with one blank between them."""
    text, at = data.tobytes(), offsets.tolist()
    digests = b"".join(hashlib.blake2b(b" ".join(text[a:b].translate(LOWER).split()), digest_size=16).digest() for a, b in zip(at[:-1], at[1:], strict=True))
    both = np.frombuffer(digests, U).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def parts_of(band: np.ndarray) -> np.ndarray:
    """Number of parts of the domain for bands that start at L: three for each block, or single ones."""
    band = np.maximum(band.astype(float), 1)
    return np.where(band < PAIRS_BELOW, 3 * np.maximum(np.round(0.45 * band), 1), np.ceil((0.68 + 1.2 / np.sqrt(band)) * band)).astype(np.int64)


def signatures(sets: np.ndarray, at: np.ndarray, upper: bool) -> tuple[np.ndarray, ...]:
    """Of each set in its own band, or with ``upper`` in the next one: (signatures, their sets, and for each set the space, the number of
    signatures it may do without, and whether it is short and takes part)."""
    size = np.diff(at)
    band = (1 << np.floor(np.log2(np.maximum(size, 1))).astype(np.int64)) * (2 if upper else 1)
    takes = (size > 0) & ((100 * size >= SIMILARITY * band) if upper else True)
    partner = size * 100 // SIMILARITY if upper else np.minimum(size * 100 // SIMILARITY, 2 * band - 1)
    most = (size + partner) * (100 - SIMILARITY) // (100 + SIMILARITY)  # d
    row = np.repeat(np.arange(len(size)), size)
    chosen = takes[row]
    row, shingles = row[chosen], sets[chosen]
    # sorted shingles give sorted parts, as the part comes from the shingle's upper bits
    part = (((shingles >> U(33)) * parts_of(band)[row].astype(U)) >> U(31)).astype(np.int64)
    first = np.ones(len(row), bool)
    first[1:] = (part[1:] != part[:-1]) | (row[1:] != row[:-1])
    start = np.flatnonzero(first)
    inside = _sums(mix(shingles, 5), np.append(start, len(shingles)))
    row, part = row[start], part[start]
    paired = (band < PAIRS_BELOW)[row]
    place = band.astype(U)[row] << U(32)

    alone = ~paired
    tokens = [mix(inside[alone] ^ mix(place[alone] ^ part[alone].astype(U), 6), 7)]
    owners = [row[alone]]
    held = np.bincount(owners[0], minlength=len(size))
    spare = held - most - 1
    # blocks of three parts: their contents side by side, and the pairs of them that are not empty
    r, block, role = row[paired], part[paired] // 3, part[paired] % 3
    new = np.ones(len(r), bool)
    new[1:] = (block[1:] != block[:-1]) | (r[1:] != r[:-1])
    at_block = np.cumsum(new) - 1
    content, filled = np.zeros((int(new.sum()), 3), U), np.zeros((int(new.sum()), 3), bool)
    content[at_block, role], filled[at_block, role] = mix(inside[paired], 10), True
    owner, where = r[new], mix(place[paired][new] ^ block[new].astype(U), 6)
    for i, j in ((0, 1), (0, 2), (1, 2)):
        some = filled[:, i] | filled[:, j]
        tokens.append(mix(mix(content[some, i], 11 + i) ^ mix(content[some, j], 21 + j) ^ where[some], 12 + i + j))
        owners.append(owner[some])
    full = np.bincount(owner[filled.sum(1) >= 2], minlength=len(size))
    common = np.where(most <= full, 3 * full - 2 * most, 2 * full - most)
    spare = np.where(band < PAIRS_BELOW, common - 1, spare)
    space = np.log2(band).astype(np.int8)
    return np.concatenate(tokens), np.concatenate(owners), space, np.maximum(spare, 0), takes & (spare < 0)


def all_signatures(sets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """(signature, set, space, spare) of all signatures of the sets."""
    size = np.diff(at)
    short = np.zeros(len(size), bool)
    out = []
    for upper in (False, True):
        tokens, owner, space, spare, lacks = signatures(sets, at, upper)
        out.append((tokens, owner, space[owner], spare[owner]))
        short |= lacks
    row = np.repeat(np.arange(len(size)), size)
    chosen = short[row]
    row = row[chosen]
    spare = np.maximum(size - size * (100 - SIMILARITY) // SIMILARITY - 1, 0)
    out.append((mix(sets[chosen], 13), row, np.full(len(row), FINEST, np.int8), spare[row]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def sketches(sets: np.ndarray, at: np.ndarray) -> list[bytes]:
    """For each set a bit map of the parity of its shingles' hashes, of as many bits as shingles at least.

    The XOR of two maps is the map of the sets' symmetric difference, so its ones never outnumber that difference: a pair
    with more ones than similar sets can differ in is refused without a look at the texts, and no similar pair is.
    """
    size = np.diff(at)
    bits = 64 * (1 << np.ceil(np.log2(np.maximum(size, 64) / 64)).astype(np.int64))
    begin = np.concatenate((np.zeros(1, np.int64), np.cumsum(bits)))
    row = np.repeat(np.arange(len(size)), size)
    where = begin[row] + (mix(sets, 8) & (bits[row] - 1).astype(U)).astype(np.int64)
    packed = np.packbits((np.bincount(where, minlength=int(begin[-1])) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [packed[a // 8 : b // 8] for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]


def may_be_similar(n_a: int, sketch_a: bytes, n_b: int, sketch_b: bytes) -> bool:
    """False only for sets that differ in too many shingles."""
    a, b = int.from_bytes(sketch_a, "little"), int.from_bytes(sketch_b, "little")
    bits_a, bits_b = 8 * len(sketch_a), 8 * len(sketch_b)
    while bits_a != bits_b:  # the longer map, folded, is the map of half as many bits
        if bits_a > bits_b:
            bits_a //= 2
            a = (a >> bits_a) ^ (a & ((1 << bits_a) - 1))
        else:
            bits_b //= 2
            b = (b >> bits_b) ^ (b & ((1 << bits_b) - 1))
    return (a ^ b).bit_count() * (100 + SIMILARITY) <= (n_a + n_b) * (100 - SIMILARITY)


def _text_of(batch: pa.RecordBatch) -> pa.Array:
    return batch.column(batch.schema.get_field_index("text"))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size, a, b, maps = [], [], [], []
        for _, _, data, offsets in text_slices(_text_of(batch)):
            sets, at = shingle_sets(data, offsets)
            x, y = word_digests(data, offsets)
            size.append(np.diff(at).astype(np.int32))
            a.append(x.view(np.int64))
            b.append(y.view(np.int64))
            maps += sketches(sets, at)
        if size:
            columns = [batch.column(batch.schema.get_field_index("doc_id")), *(pa.array(np.concatenate(x)) for x in (size, a, b)), pa.array(maps, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "node", "check", "sketch"])


def _signatures(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of (bucket, tokens, homes, nodes, spaces, spares), the signatures of a slice in a bucket; each task gives the signatures of a set
    once, however many copies it reads, and deals those of a signature that many sets hold to SALTS buckets after the first ones: only
    these have homes, the buckets that name them. Two signatures of one name only make more sets meet."""
    seen: set[int] = set()
    heavy = np.zeros(0, U)
    for batch in batches:
        for _, _, data, offsets in text_slices(_text_of(batch), SLICE):
            sets, at = shingle_sets(data, offsets)
            nodes, _ = word_digests(data, offsets)
            size = np.diff(at)
            fresh = np.zeros(len(nodes), bool)
            for i, x in enumerate(nodes.tolist()):
                if size[i] and x not in seen:
                    fresh[i] = True
                    seen.add(x)
            if len(seen) > REMEMBERED:
                seen.clear()
            row = np.repeat(np.arange(len(size)), size)
            sets, size, nodes = sets[fresh[row]], size[fresh], nodes[fresh]
            at = np.concatenate((np.zeros(1, np.int64), np.cumsum(size)))
            tokens, owner, space, spare = all_signatures(sets, at)
            if not len(tokens):
                continue
            home = (((tokens >> U(32)) * U(buckets)) >> U(32)).astype(np.uint16)
            tokens = (home.astype(U) << U(32)) | (tokens & U(0xFFFFFFFF))
            spare = np.minimum(spare, 32_767).astype(np.int16)
            order = np.argsort(tokens)
            ordered = tokens[order]
            begin = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
            count = np.diff(np.append(begin, len(tokens)))
            nth = np.arange(len(tokens)) - np.repeat(begin, count)
            salted = np.zeros(len(tokens), bool)  # the rows keep the order of sets, in which they take less room
            salted[order] = np.repeat(np.isin(ordered[begin], heavy), count) | (nth >= HEAVY)
            heavy = np.union1d(heavy, ordered[begin[count > HEAVY]])
            common = order[np.repeat(count > 1, count)]
            common = common[np.lexsort((owner[common], tokens[common]))]
            twice = owner[common[1:]][(tokens[common[1:]] == tokens[common[:-1]]) & (owner[common[1:]] == owner[common[:-1]])]
            spare[np.isin(owner, twice)] = 0  # a set that holds two signatures of one name has fewer to share
            nodes = nodes[owner]
            away = (((mix(tokens ^ mix(nodes % U(SALTS)), 14) >> U(32)) * U(buckets)) >> U(32)).astype(np.uint16)
            for chosen, bucket in ((~salted, home), (salted, away)):
                order = np.flatnonzero(chosen)
                if len(order):
                    order = order[np.argsort(bucket[order], kind="stable")]
                    bucket = bucket[order].astype(np.int32)
                    begin = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
                    at = pa.array(np.append(begin, len(order)).astype(np.int32))
                    homes = at if chosen is salted else pa.array(np.zeros(len(at), np.int32))
                    lists = [pa.ListArray.from_arrays(at, pa.array(x[order])) for x in (tokens.astype(np.uint32).view(np.int32), nodes.view(np.int64), space, spare)]
                    lists.insert(1, pa.ListArray.from_arrays(homes, pa.array(home[order].astype(np.int32) if chosen is salted else bucket[:0])))
                    yield pa.RecordBatch.from_arrays([pa.array(bucket[begin]), *lists], ["bucket", "token", "home", "node", "space", "spare"])


def _shared(rows: pa.Table) -> pa.Table:
    """Of a bucket, rows of (token, salted, node, space, spare, m): signatures that m >= 2 sets hold, and the salted ones.

    Infrequent signatures only tell which sets to compare. Those of the same sets are given once, under a token that stands for these sets:
    two copies of a long text share hundreds of signatures, all of one group.
    """
    lists = {c: rows.column(c).combine_chunks() for c in ("token", "home", "node", "space", "spare")}
    token, home, node, space, spare = (x.flatten().to_numpy() for x in lists.values())
    count = lists["token"].value_lengths().to_numpy()
    salted = np.repeat(lists["home"].value_lengths().to_numpy() > 0, count)
    named = np.repeat(rows.column("bucket").to_numpy().astype(U), count)
    named[salted] = home
    token, node = (named << U(32)) | token.view(np.uint32), node.view(U)
    plain = np.flatnonzero(~salted)
    order = plain[np.argsort(token[plain])]
    new = np.ones(len(order) + 1, bool)  # and an end
    new[1:-1] = token[order][1:] != token[order][:-1]
    order = order[~(new[:-1] & new[1:])]  # the signatures that come once go before the rest is sorted by sets
    order = order[np.lexsort((node[order], token[order]))]
    t, v = token[order], node[order]
    once = np.ones(len(order), bool)
    once[1:] = (t[1:] != t[:-1]) | (v[1:] != v[:-1])  # a set comes once for each task that reads a copy of it
    order, t, v = order[once], t[once], v[once]
    begin = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1]))) if len(t) else np.zeros(0, np.int64)
    count = np.diff(np.append(begin, len(t)))
    group = np.zeros(len(begin), U) if not len(t) else mix(_sums(mix(v, 15), np.append(begin, len(t))) ^ count.astype(U), 16)
    first = np.zeros(len(begin), bool)
    first[np.unique(group, return_index=True)[1]] = True
    chosen = (count > FREQUENT) | ((count > 1) & first)
    m, seldom = np.repeat(count, count), np.repeat(count <= FREQUENT, count)
    t = np.where(seldom, np.repeat(group, count), t)
    chosen = np.repeat(chosen, count)
    order, t, m = order[chosen], t[chosen], m[chosen]
    heavy = np.flatnonzero(salted)
    rest = np.concatenate((order, heavy))
    columns = [np.concatenate((t, token[heavy])).view(np.int64), salted[rest], node[rest].view(np.int64), space[rest], spare[rest], np.concatenate((m, np.full(len(heavy), FREQUENT + 1))).astype(np.int64)]
    return pa.Table.from_arrays([pa.array(c) for c in columns], ["token", "salted", "node", "space", "spare", "m"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (a, b, n_a, sketch_a, n_b, sketch_b), the pairs (a, b) that may be similar."""
    for batch in batches:
        good = [may_be_similar(*x) for x in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True)]
        kept = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))
        if kept.num_rows:
            yield kept


def _numbered(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    return np.array([known.setdefault(w, len(known)) for w in words], np.int64)


def similar_texts(a: str, b: str) -> bool:
    """Exact: words get numbers, and equal sequences of 2, 4 and 5 words get equal numbers in turn."""
    known: dict[bytes, int] = {}
    one, two = (_numbered((t or "").encode().translate(LOWER).split(), known) for t in (a, b))
    if min(len(one), len(two)) < WORDS:
        return len(one) > 0 and np.array_equal(one, two)  # a single shingle, or none, on one side: (1 of n >= 2 is under 0.75)
    both, cut = np.concatenate((one, two)), len(one)
    pairs = np.unique(both[:-1] * len(known) + both[1:], return_inverse=True)[1]
    fours = np.unique(pairs[:-2] * (int(pairs.max()) + 1) + pairs[2:], return_inverse=True)[1]
    fives = fours[:-1] * len(known) + both[4:]
    x, y = np.unique(fives[: cut - WORDS + 1]), np.unique(fives[cut:])
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= SIMILARITY * (len(x) + len(y) - common)


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (a, b, text_a, text_b), the pairs (a, b) that are similar."""
    for batch in batches:
        good = [similar_texts(batch.column(2)[i].as_py(), batch.column(3)[i].as_py()) for i in range(batch.num_rows)]
        kept = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))
        if kept.num_rows:
            yield kept


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (cluster, component, out, hub, y, text_hub, text_y), rows of the symmetric difference, with the number of the sets' and of
    the difference's shingles; out becomes false for a set that is similar to the hub, whose link the star has found."""
    last, hub_set = None, None
    for batch in batches:
        rows, parts = [], []
        for i in range(batch.num_rows):
            cluster, component, out, hub, y = (batch.column(k)[i].as_py() for k in range(5))
            if hub != last:
                last, hub_set = hub, _one_set(batch.column(5)[i].as_py())
            own = _one_set(batch.column(6)[i].as_py())
            parts.append(np.setxor1d(hub_set, own, assume_unique=True))
            near = len(parts[-1]) * (100 + SIMILARITY) <= (len(hub_set) + len(own)) * (100 - SIMILARITY)
            rows.append((cluster, component, out and not near, y, len(own), len(parts[-1])))
        if parts:
            count = [len(p) for p in parts]
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int32())
            columns = [pa.array(c, k).take(pa.array(np.repeat(np.arange(len(count)), count))) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(parts).view(np.int64))], ["cluster", "component", "out", "y", "n_y", "size", "shingle"])


def _one_set(text: str) -> np.ndarray:
    data = np.frombuffer((text or "").encode(), np.uint8)
    return shingle_sets(data, np.array([0, len(data)]))[0]


def _sizes_agree(a: str, b: str) -> F.Column:
    small, large = F.least(F.col(a), F.col(b)), F.greatest(F.col(a), F.col(b))
    return 100 * small >= SIMILARITY * large


def _shared_signatures(docs: DataFrame, shingles: int, scratch: Scratch) -> DataFrame:
    """Rows (token, node, space, often) of the signatures that two sets or more hold, without the frequent ones that a set can spare;
    often is the number of frequent signatures of the set in the space, and null for infrequent signatures."""
    buckets = min(max(shingles // BUCKET, LEAST_BUCKETS), MOST_BUCKETS)
    lists = "bucket int, token array<int>, home array<int>, node array<long>, space array<byte>, spare array<short>"
    tokens = docs.select("text").mapInArrow(partial(_signatures, buckets=buckets), lists)
    shared = tokens.groupBy("bucket").applyInArrow(_shared, "token long, salted boolean, node long, space byte, spare short, m long")
    shared = scratch.write(shared, "shared")
    heavy = broadcast_if_small(scratch.write(shared.filter("salted").select("token").distinct(), "heavy"))
    often = shared.filter(F.col("m") > FREQUENT).join(heavy.withColumn("_heavy", F.lit(True)), "token", "left")
    often = often.withColumn("m", F.when(F.col("_heavy"), F.lit(2**62)).otherwise(F.col("m"))).dropDuplicates(["token", "node"])
    commonest = Window.partitionBy("node", "space").orderBy(F.col("m").desc(), F.col("token").desc())
    whole = Window.partitionBy("node", "space")
    often = often.select("*", F.row_number().over(commonest).alias("_nth"), F.count(F.lit(1)).over(whole).alias("often"))
    kept = often.filter(F.col("_nth") > F.col("spare")).select("token", "node", "space", "often")
    seldom = shared.filter(F.col("m") <= FREQUENT).select("token", "node").distinct()
    seldom = seldom.select("token", "node", F.lit(0).cast("byte").alias("space"), F.lit(None).cast("long").alias("often"))
    kept = scratch.write(seldom.unionByName(kept), "kept")
    scratch.drop("shared")
    return kept


def _verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Of pairs (a, b) of documents that stand for their sets, the similar ones."""
    one = sets.select(F.col("first").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("sketch_a"))
    two = sets.select(F.col("first").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("sketch_b"))
    ids = pairs.join(one, "a").join(two, "b").filter(_sizes_agree("n_a", "n_b")).select("a", "b", "n_a", "sketch_a", "n_b", "sketch_b")
    ids = scratch.write(ids.mapInArrow(_near, "a long, b long"), f"{name}-pairs")
    texts = _texts(ids.select(F.col("a").alias("doc_id")).union(ids.select("b")), docs, scratch, name)
    both = ids.join(texts.withColumnsRenamed({"doc_id": "a", "text": "text_a"}), "a")
    both = both.join(texts.withColumnsRenamed({"doc_id": "b", "text": "text_b"}), "b").select("a", "b", "text_a", "text_b")
    found = scratch.write(both.mapInArrow(_similar, "a long, b long"), name)
    scratch.drop(f"{name}-texts")
    return found


def _texts(ids: DataFrame, docs: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(doc_id, text) of the ids."""
    wanted = broadcast_if_small(scratch.write(ids.distinct(), f"{name}-ids"))
    return scratch.write(docs.join(wanted, "doc_id", "left_semi"), f"{name}-texts")


def link(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles (int), component_id (the smallest id it is linked to, itself included).

    Texts that are null or have no words have an empty set and are linked with nothing. Repeated rows count as copies.
    Rows that share an id are one document. A null id is linked with nothing and has a null component. Ids are whole
    numbers. Other columns are not read; an empty table gives an empty table. Long texts are read whole, in pieces.
    """
    return _linked(docs, Scratch(docs.sparkSession, "ngram-join"), key, text)


def _linked(docs: DataFrame, scratch: Scratch, key: str, text: str) -> DataFrame:
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    keys = scratch.write(docs.mapInArrow(_keys, "doc_id long, n int, node long, check long, sketch binary"), "keys")
    known = keys.filter("n > 0 and doc_id is not null")
    sets = scratch.write(known.groupBy("node", "check", "n").agg(F.min("doc_id").alias("first"), F.first("sketch").alias("sketch")), "sets")
    docs = docs.filter("doc_id is not null")

    shingles = keys.agg(F.sum("n")).first()[0] or 0
    kept = _shared_signatures(docs, shingles, scratch).join(sets.select("node", "first"), "node").drop("node")
    kept = scratch.write(kept, "groups")
    scratch.drop("kept")
    hubs = kept.groupBy("token").agg(F.max(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "first")).alias("hub"))
    star = kept.join(hubs.select("token", F.col("hub.first").alias("a")), "token").select("a", F.col("first").alias("b")).filter("a != b")
    tried = scratch.write(star.distinct(), "star")
    links = _verified(tried, sets, docs, scratch, "star-links")
    reach = scratch.write(connected(links, scratch, "star"), "star-components")

    # groups that still hold several components
    inside = kept.join(reach.withColumnRenamed("id", "first"), "first", "left").withColumn("component", F.coalesce("component", "first"))
    inside = scratch.write(inside, "inside")
    scratch.drop("groups")
    several = inside.groupBy("token").agg(F.min("component").alias("_low"), F.max("component").alias("_high")).filter("_low < _high").select("token")
    open_rows = scratch.write(inside.join(several, "token", "left_semi"), "open")
    scratch.drop("inside")
    across = _pairs_in_groups(open_rows.filter("often is null")).unionByName(_pairs_by_difference(open_rows.filter("often is not null"), docs, scratch)).distinct()
    across = scratch.write(across.join(tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"), "across")
    more = _verified(across, sets, docs, scratch, "links")

    copies = known.join(sets.drop("n"), ["node", "check"]).select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    twice = copies.groupBy("b").agg(F.min("a").alias("a"), F.max("a").alias("_z")).filter("a < _z")  # ids with several sets
    twice = copies.join(twice.select("b"), "b").select("a", "b").filter("a != b")
    whole = scratch.write(connected(links.unionByName(more).unionByName(twice), scratch, "all"), "components")
    for name in ("star", "star-components", "open", "across", "differences"):
        scratch.drop(name)

    named = sets.join(whole.withColumnRenamed("id", "first"), "first", "left").select("node", "check", F.coalesce("component", "first").alias("_c"))
    out = keys.drop("sketch").join(named, ["node", "check"], "left")
    linked = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(linked, F.coalesce("_c", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _pairs_in_groups(rows: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of the components of groups with infrequent signatures."""
    right = rows.select(F.col("token").alias("_t"), F.col("first").alias("b"), F.col("component").alias("_c"))
    pairs = rows.join(right, (F.col("token") == F.col("_t")) & (F.col("component") != F.col("_c")) & (F.col("first") < F.col("b")))
    return pairs.select(F.col("first").alias("a"), "b").distinct()


def _clusters(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(cluster, hub, y, component, out) for the sets of each cluster but its hub; out tells that y is not in the hub's component."""
    rows = rows.withColumn("vertex", F.xxhash64("space", "first"))
    centre = rows.groupBy("token").agg(F.min("vertex").alias("b"))
    found = connected(rows.join(centre, "token").select(F.col("vertex").alias("a"), "b"), scratch, "clusters")
    members = rows.groupBy("vertex", "first", "component").agg(F.max("often").alias("often"))
    members = scratch.write(members.join(found.select(F.col("id").alias("vertex"), F.col("component").alias("cluster")), "vertex"), "members")
    hubs = members.groupBy("cluster").agg(F.max(F.struct("often", "first", "component")).alias("hub"))
    hubs = broadcast_if_small(scratch.write(hubs.select("cluster", F.col("hub.first").alias("hub"), F.col("hub.component").alias("_main")), "hubs"))
    met = members.join(hubs, "cluster").filter("first != hub")
    return scratch.write(met.select("cluster", "component", (F.col("component") != F.col("_main")).alias("out"), "hub", F.col("first").alias("y")), "met")


def _pairs_by_difference(rows: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs (a, b), a < b, of sets of one cluster and different components, which share a rare difference to the cluster's hub.
    The hub is the hub of all its groups, so its own pairs have been tried."""
    met = _clusters(rows, scratch)
    texts = _texts(met.select(F.col("y").alias("doc_id")).union(met.select("hub")), docs, scratch, "met")
    hubs = met.select("cluster", "hub").distinct().join(texts.withColumnsRenamed({"doc_id": "hub", "text": "text_hub"}), "hub")
    hubs = hubs.select("cluster", "text_hub", F.explode(F.sequence(F.lit(0), F.lit(HUB_SALTS - 1))).alias("salt"))
    pairs = met.join(texts.withColumnsRenamed({"doc_id": "y", "text": "text_y"}), "y").withColumn("salt", F.pmod(F.xxhash64("y"), F.lit(HUB_SALTS)).cast("int"))
    pairs = pairs.join(hubs, ["cluster", "salt"]).select("cluster", "component", "out", "hub", "y", "text_hub", "text_y")
    apart = pairs.mapInArrow(_differences, "cluster long, component long, out boolean, y long, n_y int, size int, shingle long")
    apart = scratch.write(apart, "differences")
    scratch.drop("met-texts")
    often = apart.groupBy("cluster", "shingle").agg(F.count(F.lit(1)).alias("m"), (F.max("out") & (F.min("component") < F.max("component"))).alias("_open")).filter("m > 1")
    some = apart.join(often, ["cluster", "shingle"], "left").withColumn("m", F.coalesce("m", F.lit(1)))
    some = some.withColumn("_nth", F.row_number().over(Window.partitionBy("cluster", "y").orderBy("m", "shingle"))).filter("_open")
    # similar sets' differences to the hub differ in size by no more than the sets, so either shares one of its n * (1 - t) / t + 1 rarest:
    # what most sets of a cluster lack of the hub's is not joined
    some = some.filter(SIMILARITY * (F.col("_nth") - 1) <= (100 - SIMILARITY) * F.col("n_y"))
    side = lambda *names: [F.col(c).alias(n) for c, n in zip(("y", "n_y", "size", "_nth", "component"), names, strict=True)]
    left = some.filter("out").select(F.col("cluster").alias("_h"), F.col("shingle").alias("_s"), *side("p", "_np", "_sp", "_kp", "_cp"))
    right = some.select("cluster", "shingle", *side("q", "_nq", "_sq", "_kq", "_cq"))
    # what both differences must share, and hence how many of either's rarest can be missed
    most = 2 * (100 + SIMILARITY)
    shared = (100 + SIMILARITY) * (F.col("_sp") + F.col("_sq")) - (100 - SIMILARITY) * (F.col("_np") + F.col("_nq"))
    among_rarest = (most * (F.col("_kp") - 1) <= most * F.col("_sp") - shared) & (most * (F.col("_kq") - 1) <= most * F.col("_sq") - shared)
    near = (100 + SIMILARITY) * F.abs(F.col("_sp") - F.col("_sq")) <= (100 - SIMILARITY) * (F.col("_np") + F.col("_nq"))
    pairs = left.join(right, near & (F.col("cluster") == F.col("_h")) & (F.col("shingle") == F.col("_s")) & (F.col("_cp") != F.col("_cq")) & among_rarest & _sizes_agree("_np", "_nq"))
    return pairs.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()


def first_of_each(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the documents that are linked to one with a smaller id; of rows that repeat an id, one stays."""
    scratch, inner = Scratch(docs.sparkSession, "ngram-dedup"), Scratch(docs.sparkSession, "ngram-join")
    found = scratch.write(_linked(docs, inner, key, text), "links")
    inner.drop()
    goes = broadcast_if_small(scratch.write(found.filter("component_id < doc_id").select(F.col("doc_id").alias("_goes")).distinct(), "goes"))
    stays = docs.join(goes, docs[key] == F.col("_goes"), "left_anti")
    twice = found.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").select(F.col("doc_id").alias("_twice"))
    twice = broadcast_if_small(scratch.write(twice, "twice"))
    once = stays.join(twice, stays[key] == F.col("_twice"), "left_anti")
    return once.unionByName(stays.join(twice, stays[key] == F.col("_twice"), "left_semi").dropDuplicates([key]))
