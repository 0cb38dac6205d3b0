"""N-gram Jaccard join: size-aware, heavy-light, exact.

A document is the set of its distinct word shingles, as 64-bit hashes. Equal sets form a class and join as one.
Shingles have one global order: those in most texts last, else by hash. How many texts hold each shingle is counted over all
rows, one of each group of equal texts (by the upper KEY_BITS of its hash; the lists that meet use all of them): tasks sum sorted runs
of shingles, and each range of the hashes is summed by one task. A linked pair must share a shingle among the first p = n - ceil(t n) + 1 of each, and two among the first p + 1.

Small sets (up to a boundary that the costs by all sets' sizes and counts choose) enumerate the subsets of two of their first p + 1 shingles; pairs
of small sets meet in an equal subset. Larger sets, and small ones near the boundary, go into inverted lists of
their first p shingles, which are scanned. Subsets make more rows, lists more meetings of sets that don't link, and a meeting costs
MEETING rows. Of either kind only lists with two sets or more are kept. Lists of over LIST_ROWS sets are dealt in blocks: by another
hash in each of the first rounds, and as pairs of blocks in the last, so no task holds a list.

The first rounds take from every list one partner for each set at most, of another component: of the list's hubs, sets with
most links so far or most sets met in all their lists, else the smallest of fitting size. The best partner of each set is compared, and linked sets become
components. The last round takes all other pairs of every list, but only between sets that are still in different
components, sums up how many lists they share, and compares those that can reach the threshold. Of those pairs it
makes rows only where the sets' parity bitmaps allow a link: each bit that differs stands for a shingle at least that one
set lacks, so a pair with more such bits than a linked pair may differ in is never one. So a group of copies
costs about as many comparisons as it has members in each round, and no link that joins two components is lost.

Defined cases: a null or empty text, or one of blanks, has an empty set and links with nothing; a text with fewer words
than a shingle is one shingle; rows with equal ids stay rows of their own; a null id takes the smallest id of its
component, null if there is none; an empty table gives no rows; further columns are ignored. Hashes of 64 bits
stand for shingles and sets; two sets of different texts are taken for equal with a chance of 2^-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .runtime import arrow_schema, ddl, discard, sliced, small_batches, stored, texts

U = np.uint64
#: Sets of a list, or of a block of one, in a task; rows that a meeting of two sets in a list costs (it is joined with what
#: is known of both in each round, made a pair, shuffled, summed).
LIST_ROWS, MEETING = 20_000, 10
#: Bits of a shingle's hash that it is counted by; shingles that a task sums at once; bytes of text whose shingles make a range.
KEY_BITS, RUN, RANGE_BYTES = 48, 500_000, 8_000_000
_POWER = U(0x9E3779B97F4A7C15 | 1)
_INVERSE = U(pow(int(_POWER), -1, 1 << 64))
_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit (splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, n.bit_length())
    if size not in _TABLES:
        _TABLES.clear()
        one = np.ones(1, U)
        _TABLES[size] = tuple(np.concatenate([one, np.multiply.accumulate(np.full(size - 1, p, U))]) for p in (_POWER, _INVERSE))
    return _TABLES[size]


def word_hashes(batch: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (A-Z in lower case) of texts, one text after another, and where each text's words end."""
    data = np.frombuffer(b"\n".join(batch) + b"\n", np.uint8)
    upper = (data >= 65) & (data <= 90)
    data = data + (upper * np.uint8(32)).astype(np.uint8)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank]).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    power, inverse = powers(len(data))
    total = np.concatenate([np.zeros(1, U), np.cumsum((data.astype(U) + U(1)) * power[: len(data)])])
    hashes = mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(U))
    stops = np.cumsum(np.fromiter((len(b) + 1 for b in batch), np.int64, len(batch)))
    return hashes, np.searchsorted(starts, stops)


def shingle_sets(batch: list[bytes], size: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of the shingles of each text."""
    hashes, stops = word_hashes(batch)
    grams = np.zeros(0, U)
    if len(hashes) >= size:
        grams = np.zeros(len(hashes) - size + 1, U)
        for k in range(size):
            grams = mix(grams + hashes[k : k + len(grams)])
    begin = 0
    for stop in stops.tolist():
        n = stop - begin
        if n >= size:
            got = np.sort(grams[begin : stop - size + 1])
            yield got[np.concatenate([[True], got[1:] != got[:-1]])]
        elif n:
            one = np.full(1, n, U)
            for h in hashes[begin:stop]:
                one = mix(one + h)
            yield one
        else:
            yield np.zeros(0, U)
        begin = stop


def grouped(batch: list[str], limit: int = 500_000) -> Iterator[list[bytes]]:
    """Texts in lists of about so many bytes; a longer text comes alone."""
    out, size = [], 0
    for x in batch:
        b = x.encode("utf-8", "replace")
        if out and size + len(b) > limit:
            yield out
            out, size = [], 0
        out.append(b)
        size += len(b)
    if out:
        yield out


def need(n: np.ndarray, percent: int, of: int = 100) -> np.ndarray:
    """ceil(t n): shingles that a set of n shares with any linked one; of 100 + percent, those that two sets of n together share."""
    return -(-n * percent // of)


def width(n: np.ndarray) -> np.ndarray:
    """Bits of the bitmap of a set of n: a power of two from n on, 64 to 1024. Sizes that can link differ by one doubling at most."""
    return np.clip(2 ** np.ceil(np.log2(np.maximum(n, 1))), 64, 1024).astype(np.int64)


def bitmap(s: np.ndarray) -> bytes:
    """Parity of the number of shingles at each place."""
    w = int(width(np.int64(len(s))))
    return np.packbits(np.bincount((s & U(w - 1)).astype(np.int64), minlength=w).astype(np.uint8) & 1, bitorder="little").tobytes()


def bitmaps(column: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Widths in words of 64 bits, the bitmaps padded with zeros, and the same folded to half their width."""
    words = np.fromiter((len(x) // 8 for x in column), np.int64, len(column))
    full = np.zeros((len(column), 16), U)
    half = np.zeros((len(column), 16), U)
    for w in np.unique(words).tolist():
        at = np.flatnonzero(words == w)
        full[at, :w] = np.frombuffer(b"".join(column[at]), "<u8").reshape(len(at), w)
        if w > 1:
            half[at, : w // 2] = full[at, : w // 2] ^ full[at, w // 2 : w]
    return words, full, half


def sketches(docs: DataFrame, size: int, percent: int, heavy: np.ndarray) -> DataFrame:
    """heavy: sorted keys of the shingles that come last. Per row: id, rid (id, or a hash of the text), n, set (hash of the whole set), bits (its bitmap) and first, the first p + 1 shingles in the global order."""
    schema = arrow_schema(id="long", rid="long", n="long", set="long", bits="binary", first="longs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sets, bits, firsts = [], [], [], []
            for part in grouped(texts(batch.column(2))):
                for s in shingle_sets(part, size):
                    n.append(len(s))
                    sets.append(set_hash(s))
                    bits.append(bitmap(s))
                    p = len(s) - int(need(np.int64(len(s)), percent)) + 1
                    if len(heavy) and len(s):
                        keys = s >> U(64 - KEY_BITS)
                        common = heavy[np.minimum(np.searchsorted(heavy, keys), len(heavy) - 1)] == keys
                        s = np.concatenate([s[~common][: p + 1], s[common][: p + 1]])
                    firsts.append(s[: p + 1].view(np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in firsts])]).astype(np.int32)
            flat = np.concatenate(firsts) if firsts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(sets, pa.int64()), pa.array(bits, pa.binary()), pa.ListArray.from_arrays(offsets, flat).cast(schema.field("first").type)], schema=schema)

    return docs.mapInArrow(sliced(run), ddl(schema))


def set_hash(s: np.ndarray) -> int:
    """Hash of a sorted set."""
    if not len(s):
        return 0
    both = np.bitwise_xor.reduce(mix(s * U(3)), keepdims=True) + np.add.reduce(s, keepdims=True) * U(5) + np.full(1, len(s), U)
    return int(mix(both).view(np.int64)[0])


def whole_sets(docs: DataFrame, size: int) -> DataFrame:
    """set and shingles of each row (id, rid, text)."""
    schema = arrow_schema(set="long", shingles="longs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in grouped(texts(batch.column(2))):
                all_ = list(shingle_sets(part, size))
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in all_])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([set_hash(s) for s in all_], pa.int64()), pa.ListArray.from_arrays(offsets, np.concatenate(all_).view(np.int64)).cast(schema.field("shingles").type)], schema=schema)

    return docs.mapInArrow(sliced(run), ddl(schema))


def planes(x: np.ndarray) -> bytes:
    """Whole numbers by place of their bytes, without the places that are 0 in all."""
    w = -(-int(x.max()).bit_length() // 8)
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :w].T.tobytes()


def unplaned(data: bytes, size: int) -> np.ndarray:
    out = np.zeros((size, 8), np.uint8)
    w = len(data) // size
    out[:, :w] = np.frombuffer(data, np.uint8).reshape(w, size).T
    return out.view("<u8").ravel()


def summed_keys(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sum of their n (1 each if None)."""
    if n is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
    fresh = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[fresh], np.diff(np.append(fresh, len(keys))).astype(U) if n is None else np.add.reduceat(n, fresh)


def shingle_counts(docs: DataFrame, size: int, ranges: int, least: int) -> DataFrame:
    """n, times, key: each key (the upper bits of a shingle) that n >= least rows (id, rid, text) hold, times 1; of smaller n, without
    a key, how many keys have it. Sums of tasks travel as gaps between sorted keys, a row for each range of keys."""
    starts = np.array([-(-(k << KEY_BITS) // ranges) for k in range(ranges)], U)
    sums, schema = arrow_schema(range="long", size="long", gaps="binary", n="binary"), arrow_schema(n="long", times="long", key="long")

    def parts(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys, n = summed_keys(np.concatenate(held) >> U(64 - KEY_BITS))
        ends = [*np.searchsorted(keys, starts[1:]).tolist(), len(keys)]
        rows, begin = [], 0
        for k, end in enumerate(ends):
            if end > begin:
                rows.append((k, end - begin, planes(np.diff(keys[begin:end], prepend=starts[k])), planes(n[begin:end])))
            begin = end
        for k in range(0, len(rows), 1000):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[k : k + 1000], strict=True), sums, strict=True)], schema=sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            for part in grouped(texts(batch.column(2))):
                for s in shingle_sets(part, size):
                    held.append(s)
                    count += len(s)
                if count >= RUN:
                    yield from parts(held)
                    held, count = [], 0
        if count:
            yield from parts(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in runs(batches):
            begins = np.flatnonzero(np.concatenate([[True], columns[0][1:] != columns[0][:-1]]))
            for i, j in zip(begins.tolist(), [*begins[1:].tolist(), len(columns[0])], strict=True):
                of, sizes, gaps, counts = (c[i:j] for c in columns)
                keys = [np.cumsum(unplaned(g, k)) + starts[of[0]] for g, k in zip(gaps, sizes.tolist(), strict=True)]
                keys, n = summed_keys(np.concatenate(keys), np.concatenate([unplaned(c, k) for c, k in zip(counts, sizes.tolist(), strict=True)]))
                few = np.bincount(n[n < least].astype(np.int64), minlength=1)
                k = np.flatnonzero(few)
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(few[k], pa.int64()), pa.nulls(len(k), pa.int64())], schema=schema)
                keys, n = keys[n >= least].view(np.int64), n[n >= least].view(np.int64)
                for a in range(0, len(keys), 100_000):
                    b = min(a + 100_000, len(keys))
                    yield pa.RecordBatch.from_arrays([pa.array(n[a:b]), pa.array(np.ones(b - a, np.int64)), pa.array(keys[a:b])], schema=schema)

    return docs.mapInArrow(sliced(run), ddl(sums)).repartition("range").sortWithinPartitions("range").mapInArrow(merge, ddl(schema))


def common_shingles(rows: DataFrame, size: int, least: int, most: int, broadcast_rows: int = 1_000_000) -> tuple[np.ndarray, float]:
    """By the counts of all rows (id, rid, text), of equal texts one: sorted keys of the shingles in most texts, at least `least`, up to
    `most` of them (those with equal counts all or none), and the mean number of other texts that hold a shingle which isn't among them.
    Only the order of work depends on it, no result."""
    held = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = rows.withColumn("same", F.xxhash64("text"))
    several = stored(rows.groupBy("same").agg(F.min("rid").alias("first"), F.count("*").alias("k")).where("k > 1").select("same", "first"), "several")
    # two numbers of each repeated text go to the texts if counted to be few; of its rows that of the smallest rid stays
    few = several.count() <= broadcast_rows
    once = rows.join(F.broadcast(several) if few else several, "same", "left").where("first is null or rid = first").select("id", "rid", "text")
    counts = stored(shingle_counts(once, size, min(1 << (64 - KEY_BITS), 1 + held // RANGE_BYTES), least), "counts")
    times = {r["n"]: r["times"] for r in counts.groupBy("n").agg(F.sum("times").alias("times")).collect()}
    bound, kept = max([least - 1, *times]) + 1, 0
    for n in sorted((n for n in times if n >= least), reverse=True):
        if (kept := kept + times[n]) > most:
            break
        bound = n
    found = counts.where(F.col("key").isNotNull() & (F.col("n") >= bound)).select("key").collect()
    for done in (several, counts):
        discard(done)
    light = sum(n * (n - 1) * k for n, k in times.items() if n < bound)
    return np.sort(np.array([r["key"] for r in found], U)), light / max(1, sum(n * k for n, k in times.items()))


def boundary(sizes: np.ndarray, percent: int, others: float, times: np.ndarray | int = 1) -> int:
    """The size up to which enumerating subsets costs less than scanning lists, by the sizes of sets, how many have each, and the mean
    number of others in a list."""
    p = sizes - need(sizes, percent) + 1
    subsets, lists = times * (p * (p + 1) // 2), times * p * (1 + MEETING * others)
    edges = [0, *(k * 100 // (100 - percent) for k in (1, 2, 3))]  # beyond that a large group of copies would make far more subsets than list rows
    return min(edges, key=lambda x: (float(subsets[sizes <= x].sum() + lists[100 * sizes > percent * x].sum()), x))


def keyed(first: DataFrame, percent: int, edge: int) -> DataFrame:
    """Rows key, set, n: subsets of two of small sets (up to edge), single shingles of those that may link with a larger set."""
    p = F.col("n") - F.ceil(F.col("n") * percent / 100).cast("long") + 1
    lists = first.where(100 * F.col("n") > percent * edge).select(F.explode(F.slice("first", F.lit(1), p.cast("int"))).alias("key"), "set", "n")
    if not edge:
        return lists
    one = F.transform("first", lambda a, i: F.transform(F.filter("first", lambda b, j: j > i), lambda b: F.xxhash64(F.lit("pair"), a, b)))
    return lists.union(first.where(F.col("n") <= edge).select(F.explode(F.flatten(one)).alias("key"), "set", "n"))


def lists_of_many(rows: DataFrame) -> DataFrame:
    """key, set, n of the lists with two sets or more, and others, the number of other sets in the list."""
    many = rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key", (F.col("size") - 1).alias("others"))
    return rows.join(many, "key").select("key", "set", "n", "others")


def blocks_of(rows: DataFrame, *seed: int) -> Column:
    """Block of each row's list that its set is dealt to."""
    size = F.ceil((F.col("size") + 1) / LIST_ROWS).cast("long")
    return F.pmod(F.xxhash64("set", *map(F.lit, seed)), size)


def led_pairs(rows: DataFrame, percent: int, skip: int, hubs: int = 8) -> DataFrame:
    """a, b, an, bn: of each list (key, set, n, size, root, links, others), or block of one, one partner a for each set b at most, of
    another component and a fitting size: the first that fits of the list's hubs, from the one after `skip`, else the smallest set
    that fits. Hubs are the sets with most links so far, then those that meet most sets in all their lists, as the original of a
    group of near copies does. Each round deals the blocks anew, so that their hubs' components meet."""
    schema = arrow_schema(a="long", b="long", an="long", bn="long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, sets, n, root, links, others in runs(batches):
            begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for i, j in zip(begins.tolist(), [*begins[1:].tolist(), len(key)], strict=True):
                r, m = root[i:j], n[i:j]
                if (r == r[0]).all():
                    continue
                partner = np.full(j - i, -1)
                least, most = need(m, percent), m * 100 // percent
                top = np.lexsort((sets[i:j], -others[i:j], -links[i:j]))[skip : skip + hubs]
                for k in [*top.tolist(), np.searchsorted(m, least)]:
                    k = np.broadcast_to(k, partner.shape)
                    partner = np.where((partner < 0) & (r[k] != r) & (m[k] >= least) & (m[k] <= most), k, partner)
                b = np.flatnonzero(partner >= 0)
                found.append((partner[b] + i, b + i))
            if found:
                a, b = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (sets[a], sets[b], n[a], n[b])], schema=schema)

    rows = rows.select(F.xxhash64("key", blocks_of(rows, skip)).alias("key"), "set", "n", "root", "links", "others")
    return rows.repartition("key").sortWithinPartitions("key", "n", "set").mapInArrow(run, ddl(schema))


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of sorted batches, cut only where the first column changes."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        change = np.flatnonzero(columns[0][1:] != columns[0][:-1])
        if held and held[-1][0][-1] != columns[0][0]:
            yield [np.concatenate(x) for x in zip(*held, strict=True)]
            held = []
        if len(change):
            cut = change[-1] + 1
            held.append([c[:cut] for c in columns])
            yield [np.concatenate(x) for x in zip(*held, strict=True)]
            held = [[c[cut:] for c in columns]]
        else:
            held.append(columns)
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def crossing_pairs(rows: DataFrame, percent: int, block: int = 200_000) -> DataFrame:
    """a, b, an, bn, shared: pairs of a list (key, set, n, size, root, bits) in different components whose sizes and bitmaps fit, with the
    lists they share. Lists of one component are left out; long ones are met block by block."""
    schema = arrow_schema(a="long", b="long", an="long", bn="long", shared="long")

    def summed(parts: list[np.ndarray]) -> pa.RecordBatch:
        rows_ = np.concatenate(parts)
        rows_ = rows_[np.lexsort((rows_[:, 1], rows_[:, 0]))]
        fresh = np.flatnonzero(np.concatenate([[True], (rows_[1:, :2] != rows_[:-1, :2]).any(axis=1)]))
        count = np.diff(np.append(fresh, len(rows_)))
        return pa.RecordBatch.from_arrays([*(pa.array(rows_[fresh, k]) for k in range(4)), pa.array(count.astype(np.int64))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for key, sets, n, root, bits, of, own in runs(batches):
            begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            words, full, half = bitmaps(bits)
            for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(key)], strict=True):
                if (root[a:b] == root[a]).all():
                    continue
                for j in range(a + 1, b):  # n ascends: from the first whose size fits
                    lo = a + int(np.searchsorted(n[a:j], need(n[j], percent)))
                    other = np.flatnonzero((root[lo:j] != root[j]) & (own[lo:j] | (of[lo:j] != of[j]))) + lo
                    if len(other):
                        mine = np.where((words[other] == words[j])[:, None], full[j], half[j])
                        apart = np.bitwise_count(full[other] ^ mine).sum(axis=1, dtype=np.int64)
                        both = n[other] + n[j]
                        other = other[apart <= both - 2 * need(both, percent, 100 + percent)]
                    if len(other):
                        x, y = np.minimum(sets[other], sets[j]), np.maximum(sets[other], sets[j])
                        small = sets[other] < sets[j]
                        parts.append(np.stack([x, y, np.where(small, n[other], n[j]), np.where(small, n[j], n[other])], axis=1))
                        held += len(other)
                        if held >= block:
                            yield summed(parts)
                            parts, held = [], 0
        if parts:
            yield summed(parts)

    crossed = rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    rows = rows.join(crossed, "key").withColumn("block", blocks_of(rows))
    # a row goes to the pairs of its block with each one of its list; own: the pair of a block with itself
    mates = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil((F.col("size") + 1) / LIST_ROWS).cast("long") - 1))
    rows = rows.select("*", mates.alias("mate")).select(F.xxhash64("key", F.least("block", "mate"), F.greatest("block", "mate")).alias("key"), "set", "n", "root", "bits", "block", (F.col("block") == F.col("mate")).alias("own"))
    return rows.repartition("key").sortWithinPartitions("key", "n", "set").mapInArrow(run, ddl(schema))


def reachable(pairs: DataFrame, percent: int, edge: int, *more: str) -> DataFrame:
    """Pairs whose lists in common allow the threshold: the overlap is at most those plus what follows the first shingles."""
    low, high = F.least("an", "bn"), F.greatest("an", "bn")
    overlap = F.ceil((low + high) * percent / (100 + percent)).cast("long")
    rest = F.ceil(high * percent / 100).cast("long") - 1
    return pairs.where((high <= edge) | (F.col("shared") >= overlap - rest)).select("a", "b", *more)


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """u, v of the pairs a, b whose whole sets reach the threshold."""
    left = pairs.join(sets.select(F.col("set").alias("a"), F.col("shingles").alias("x")), "a")
    both = left.join(sets.select(F.col("set").alias("b"), F.col("shingles").alias("y")), "b")
    same = F.size(F.array_intersect("x", "y"))
    return both.select(F.col("a").alias("u"), F.col("b").alias("v"), same.alias("i"), (F.size("x") + F.size("y") - same).alias("w")).where(100 * F.col("i") >= percent * F.col("w")).select("u", "v")


def compared(rows: DataFrame, sketch: DataFrame, pairs: DataFrame, size: int, percent: int, name: str, broadcast_rows: int = 500_000) -> DataFrame:
    """The links among pairs a, b. The whole sets of their members alone are made again from the texts, of one row each."""
    pairs = stored(pairs, f"{name}-pairs")
    asked = pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct()
    wanted = stored(sketch.select("set", "rid").join(asked, "set", "left_semi").groupBy("set").agg(F.min("rid").alias("rid")).select("rid").distinct(), f"{name}-rows")
    # ids of 8 bytes go to the texts if counted to be few; beyond that the texts go to the ids
    few = wanted.count() <= broadcast_rows
    texts_ = rows.join(F.broadcast(wanted) if few else wanted, "rid", "left_semi").select("id", "rid", "text")
    sets = stored(whole_sets(texts_, size).dropDuplicates(["set"]), f"{name}-sets")
    found = stored(linked(pairs, sets, percent), name)
    for done in (pairs, wanted, sets):
        discard(done)
    return found


def tree(roots: DataFrame) -> DataFrame:
    """Components as links u, v."""
    return roots.select(F.col("node").alias("u"), F.col("root").alias("v"))


def known(lists: DataFrame, nodes: DataFrame, roots: DataFrame | None, links: DataFrame | None) -> DataFrame:
    """lists with the columns of nodes (by set) and what is known of each set: its component's root and the number of its links found."""
    more = [c for c in nodes.columns if c != "set"]
    nodes = nodes.withColumn("root", F.col("set")) if roots is None else nodes.join(roots.select(F.col("node").alias("set"), "root"), "set", "left")
    if links is None:
        nodes = nodes.withColumn("links", F.lit(0).cast("long"))
    else:
        degree = links.select(F.explode(F.array("u", "v")).alias("set")).groupBy("set").agg(F.count("*").alias("links"))
        nodes = nodes.join(degree, "set", "left")
    return lists.select("key", "set", "n", F.col("others").alias("size")).join(nodes, "set").select("key", "set", "n", "size", F.coalesce("root", "set").alias("root"), F.coalesce("links", F.lit(0).cast("long")).alias("links"), *more)


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 4, percent: int = 85, least: int = 3, most: int = 200_000, rounds: int = 2) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles and component_id, the smallest id reachable by links of `percent` or more."""
    small_batches(docs.sparkSession)
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text)).alias("rid"), text.alias("text"))
    heavy, others = common_shingles(rows, size, least, most)
    sketch = stored(sketches(rows, size, percent, heavy), "sketch")
    # sets under 100 / (100 - t) shingles, rounded down, link with equal ones alone
    first = sketch.where(F.col("n") * (100 - percent) >= percent).groupBy("set", "n").agg(F.first("first").alias("first"))
    first = stored(first, "first")
    sizes = np.array([(r["n"], r["times"]) for r in first.groupBy("n").agg(F.count("*").alias("times")).collect()], np.int64).reshape(-1, 2)
    edge = boundary(sizes[:, 0], percent, others, sizes[:, 1])
    lists = stored(lists_of_many(keyed(first, percent, edge)), "lists")
    met = stored(lists.groupBy("set").agg(F.sum("others").alias("others")), "met")
    merged, links = None, None
    for k in range(rounds):
        led = led_pairs(known(lists, met, merged, links), percent, k).groupBy("a", "b").agg(F.first("an").alias("an"), F.first("bn").alias("bn"), F.count("*").alias("shared"))
        # of each set the pair that shares most: so many comparisons as sets at most
        likely = reachable(led, percent, edge, "shared").groupBy("b").agg(F.max_by("a", F.struct("shared", "a")).alias("a"))
        found = compared(rows, sketch, likely.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), size, percent, f"found{k}")
        if found.isEmpty():
            break
        links = found if links is None else links.union(found)
        merged = stored(components(found if merged is None else found.union(tree(merged))), f"roots{k}")
    marked = sketch.join(met.select("set"), "set", "left_semi").groupBy("set").agg(F.first("bits").alias("bits"))
    crossing = crossing_pairs(known(lists, met.join(marked, "set"), merged, None).select("key", "set", "n", "size", "root", "bits"), percent).groupBy("a", "b").agg(F.first("an").alias("an"), F.first("bn").alias("bn"), F.sum("shared").alias("shared"))
    more = compared(rows, sketch, reachable(crossing, percent, edge), size, percent, "more")
    merged = components(more if merged is None else more.union(tree(merged)))
    classes = sketch.where("n > 0").groupBy("set").agg(F.min("id").alias("least")).join(merged.select(F.col("node").alias("set"), "root"), "set", "left").select("set", "least", F.coalesce("root", "set").alias("root"))
    classes = stored(classes, "classes")
    for done in (first, lists, met):
        discard(done)
    smallest = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    # only classes in a component of several, or with several ids, differ from their own id
    named = classes.join(smallest, "root").select("set", "component_id")
    out = sketch.select("id", "n", "set").join(named, "set", "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
