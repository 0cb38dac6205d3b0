"""Quality classifier: a byte-level convolutional network in numpy.

The UTF-8 bytes of a whole text are dealt to segments of SEGMENT bytes; each two neighbouring segments are a chunk, so
chunks overlap by half and cover the text. Learned filters of WIDTH bytes run over the learned embeddings of the bytes
(computed as sums of table rows, one table for each pair of byte places) and are max-pooled over a chunk; a dense layer
follows, whose maximum and mean over the chunks give one probability.

Trained on the driver from a bounded sample of labelled rows (`rows` of each label and `max_bytes` of text, chosen by a
hash of the id); the score is corrected back to the labels' own proportions.

Defined cases: a null or empty text is scored as one chunk of zero bytes; without labels of both kinds every
score is the share of label 1 (0.5 without labels); null ids and repeated rows are scored row by row; of rows that share
a labelled id the least text trains; an empty table gives no rows; further columns are ignored. A very long text goes through in units.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .runtime import arrow_schema, ddl, sliced, small_batches, texts

SEGMENT, WIDTH = 256, 6
#: Bytes taken at once.
UNIT = 1 << 17


@dataclass
class Net:
    """embed [256, e], filters [WIDTH, e, f], bias [f], dense [f, h], dense_bias [h], out [2 h], out_bias, shift."""

    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    shift: float = 0.0
    constant: float | None = None

    def tables(self) -> list[np.ndarray]:
        """For each two neighbouring byte places, what the filters add for each of the 65,536 pairs of bytes."""
        one = np.einsum("be,kef->kbf", self.embed, self.filters).astype(np.float32)
        return [np.ascontiguousarray((one[k][:, None, :] + one[k + 1][None, :, :]).reshape(65536, -1)) for k in range(0, WIDTH, 2)]


def segments(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the segments of documents that lie one after another, and the document of each."""
    counts = np.maximum(1, -(-lengths // SEGMENT))
    doc = np.repeat(np.arange(len(lengths)), counts)
    first = np.cumsum(counts) - counts
    begin = np.cumsum(lengths) - lengths
    return begin[doc] + (np.arange(len(doc)) - first[doc]) * SEGMENT, doc


def layout(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes (an empty text counts as one zero byte) and ends of the texts, starts and documents of the segments."""
    docs = [d or b"\0" for d in docs]
    lengths = np.fromiter(map(len, docs), np.int64, len(docs))
    return np.frombuffer(b"".join(docs), np.uint8), np.cumsum(lengths), *segments(lengths)


def shifted(data: np.ndarray, ends: np.ndarray, begin: int, n: int) -> list[np.ndarray]:
    """For each of the filters' WIDTH places, the bytes that lie so far after each of n places from begin on; zero after a text's end."""
    part = np.concatenate([data[begin : begin + n + WIDTH], np.zeros(WIDTH, np.uint8)])
    k = np.arange(np.searchsorted(ends, begin, "right"), min(len(ends), np.searchsorted(ends, begin + n + WIDTH) + 1))
    end, first = ends[k] - begin, np.where(k > 0, ends[k - 1], 0) - begin
    out = []
    for offset in range(WIDTH):
        x = part[offset : offset + n].copy()
        for back in range(1, offset + 1):
            at = end - back
            x[at[(at >= np.maximum(first, 0)) & (at < n)]] = 0
        out.append(x)
    return out


def filtered(bytes_: list[np.ndarray], tables: list[np.ndarray]) -> np.ndarray:
    """What the filters give at each place."""
    codes = [bytes_[k].astype(np.int32) * 256 + bytes_[k + 1] for k in range(0, WIDTH, 2)]
    total = tables[0].take(codes[0], axis=0)
    for code, table in zip(codes[1:], tables[1:], strict=True):
        total += table.take(code, axis=0)
    return total


def pooled(data: np.ndarray, ends: np.ndarray, starts: np.ndarray, stop: int, tables: list[np.ndarray]) -> np.ndarray:
    """Maximum of each filter over each segment, the last one of which ends before stop."""
    return np.maximum.reduceat(filtered(shifted(data, ends, int(starts[0]), stop - int(starts[0])), tables), starts - starts[0], axis=0)


def chunked(x: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Maximum of each segment and the next one of its document, if there is one."""
    after = np.append(np.arange(1, len(owner)), len(owner) - 1)
    after = np.where(owner[after] == owner, after, np.arange(len(owner)))
    return np.maximum(x, x[after])


def head(net: Net, peak: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Logit of each document."""
    feats = np.maximum(chunked(peak, owner) + net.bias, 0)
    hidden = np.maximum(feats @ net.dense + net.dense_bias, 0)
    first = np.searchsorted(owner, np.arange(n))
    counts = np.diff(np.append(first, len(owner)))
    top, mean = np.maximum.reduceat(hidden, first, axis=0), np.add.reduceat(hidden, first, axis=0) / counts[:, None]
    return np.concatenate([top, mean], axis=1) @ net.out + net.out_bias[0]


def scores(net: Net, docs: list[bytes], tables: list[np.ndarray] | None = None) -> np.ndarray:
    """Probability of label 1 for each whole text; long texts go through in units of UNIT bytes."""
    if net.constant is not None:
        return np.full(len(docs), net.constant)
    tables = tables or net.tables()
    out, at = [], 0
    while at < len(docs):
        end, size = at, 0
        while end < len(docs) and (end == at or size + len(docs[end]) <= UNIT):
            size += len(docs[end])
            end += 1
        data, ends, starts, owner = layout(docs[at:end])
        peaks, k = [], 0
        while k < len(starts):  # a unit may be one long text: whole segments at a time
            m = max(k + 1, int(np.searchsorted(starts, starts[k] + UNIT, "right")) - 1)
            peaks.append(pooled(data, ends, starts[k:m], len(data) if m >= len(starts) else int(starts[m]), tables))
            k = m
        logit = head(net, np.concatenate(peaks), owner, end - at) + net.shift
        out.append(1 / (1 + np.exp(-np.clip(logit.astype(np.float64), -40, 40))))
        at = end
    return np.concatenate(out) if out else np.zeros(0)


def train(docs: list[bytes], labels: np.ndarray, prior: float, *, seed: int = 7, epochs: int = 12, steps: int = 400, batch: int = 48, embed: int = 6, filters: int = 24, hidden: int = 8, rate: float = 0.01) -> Net:
    """Adam on the cross entropy, for `epochs` and `steps` at least; max-pooling sends each gradient to one place, so a step back is sparse."""
    labels = np.asarray(labels, np.float32)
    if len(docs) == 0 or labels.min() == labels.max():
        zero = np.zeros(1, np.float32)
        return Net(zero, zero, zero, zero, zero, zero, zero, constant=prior if len(docs) else 0.5)
    rng = np.random.default_rng(seed)
    normal = lambda *s, scale: rng.normal(0, scale, s).astype(np.float32)
    net = Net(normal(256, embed, scale=0.5), normal(WIDTH, embed, filters, scale=0.3), np.zeros(filters, np.float32), normal(filters, hidden, scale=0.3), np.full(hidden, 0.1, np.float32), normal(2 * hidden, scale=0.3), np.zeros(1, np.float32))
    names = ("embed", "filters", "bias", "dense", "dense_bias", "out", "out_bias")
    mean, square, step = {n: np.zeros_like(getattr(net, n)) for n in names}, {n: np.zeros_like(getattr(net, n)) for n in names}, 0
    laid = [layout([d]) for d in docs]
    epochs = max(epochs, -(-steps // -(-len(docs) // batch)))
    for epoch in range(epochs):
        order = rng.permutation(len(docs))
        lr = rate * (1 - epoch / epochs) + 0.001
        for k in range(0, len(order), batch):
            take = order[k : k + batch]
            data = np.concatenate([laid[i][0] for i in take])
            base = np.cumsum([0, *(len(laid[i][0]) for i in take[:-1])])
            ends = np.cumsum([len(laid[i][0]) for i in take])
            starts = np.concatenate([laid[i][2] + b for i, b in zip(take, base, strict=True)])
            owner = np.concatenate([np.full(len(laid[i][2]), j) for j, i in enumerate(take)])
            grads = gradients(net, data, ends, starts, owner, labels[take])
            step += 1
            for n in names:
                g = grads[n]
                mean[n] += 0.1 * (g - mean[n])
                square[n] += 0.01 * (g * g - square[n])
                getattr(net, n)[...] -= lr * (mean[n] / (1 - 0.9**step)) / (np.sqrt(square[n] / (1 - 0.99**step)) + 1e-6)
    share1 = float(labels.mean())
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    net.shift = float(np.log(prior / (1 - prior)) - np.log(share1 / (1 - share1)))
    return net


def gradients(net: Net, data, ends, starts, owner, y) -> dict[str, np.ndarray]:
    bytes_ = shifted(data, ends, 0, len(data))
    total = filtered(bytes_, net.tables())
    peak = np.maximum.reduceat(total, starts, axis=0)
    n, nf = len(y), peak.shape[1]
    after = np.append(np.arange(1, len(owner)), len(owner) - 1)
    after = np.where(owner[after] == owner, after, np.arange(len(owner)))
    right = peak[after] > peak
    chunk = np.where(right, peak[after], peak)
    pre = chunk + net.bias
    feats = np.maximum(pre, 0)
    z = feats @ net.dense + net.dense_bias
    hid = np.maximum(z, 0)
    first = np.searchsorted(owner, np.arange(n))
    counts = np.diff(np.append(first, len(owner))).astype(np.float32)
    top = np.maximum.reduceat(hid, first, axis=0)
    both = np.concatenate([top, np.add.reduceat(hid, first, axis=0) / counts[:, None]], axis=1)
    p = 1 / (1 + np.exp(-np.clip(both @ net.out + net.out_bias[0], -30, 30)))
    d = ((p - y) / n).astype(np.float32)
    g = {"out": both.T @ d + 1e-4 * net.out, "out_bias": d.sum(keepdims=True)}
    dboth = d[:, None] * net.out[None, :]
    h = hid.shape[1]
    hits = (hid == top[owner]).astype(np.float32)
    hits /= np.add.reduceat(hits, first, axis=0)[owner]
    dh = dboth[owner, :h] * hits + dboth[owner, h:] / counts[owner][:, None]
    dz = dh * (z > 0)
    g["dense"], g["dense_bias"] = feats.T @ dz + 1e-4 * net.dense, dz.sum(0)
    dpre = (dz @ net.dense.T) * (pre > 0)
    g["bias"] = dpre.sum(0)
    # to the place of each chunk's maximum
    segment = np.where(right, after[:, None], np.arange(len(owner))[:, None])
    dseg = np.zeros_like(peak)
    np.add.at(dseg, (segment, np.broadcast_to(np.arange(nf), segment.shape)), dpre)
    sizes = np.diff(np.append(starts, len(data)))
    hit = total == np.repeat(peak, sizes, axis=0)
    place, which = np.nonzero(hit)
    seg_of = np.repeat(np.arange(len(starts)), sizes)[place]
    _, once = np.unique(seg_of * nf + which, return_index=True)
    place, which, seg_of = place[once], which[once], seg_of[once]
    flow = dseg[seg_of, which]
    live = flow != 0
    place, which, flow = place[live], which[live], flow[live]
    g["embed"], g["filters"] = np.zeros_like(net.embed), np.zeros_like(net.filters)
    for k in range(WIDTH):
        byte = bytes_[k][place]
        np.add.at(g["embed"], byte, flow[:, None] * net.filters[k][:, which].T)
        np.add.at(g["filters"][k].T, which, flow[:, None] * net.embed[byte])
    return g


def sample(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str, rows: int, max_bytes: int, max_text: int) -> tuple[list[bytes], np.ndarray, float]:
    """Up to `rows` labelled texts of each label and the share of label 1 among all labels.

    The ids are chosen from the labels by a hash, then looked up in one scan; texts over max_text bytes don't
    train, nor does what comes after max_bytes in all.
    """
    one = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(label_col).cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in one.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    if not total:
        return [], np.zeros(0), 0.5
    picked = {}
    for y in counts:
        picked |= {r["id"]: y for r in one.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(rows).collect()}
    spark = docs.sparkSession
    ids = F.broadcast(spark.createDataFrame([(i,) for i in picked], "id long"))  # at most 2 * rows ids
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8").alias("b")).where(F.octet_length("b") <= max_text)
    got = text.join(ids, "id").groupBy("id").agg(F.min("b").alias("b")).orderBy(F.xxhash64("id"), "id").limit(2 * rows)
    out, used = [], 0
    for r in got.toLocalIterator():
        used += len(r["b"])
        if used > max_bytes:
            break
        out.append((bytes(r["b"]), picked[r["id"]]))
    return [b for b, _ in out], np.array([y for _, y in out]), counts.get(1, 0) / total


def score(docs: DataFrame, net: Net, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id, score and predicted, with the columns named in keep as struct `_kept`."""
    small_batches(docs.sparkSession)
    to = StructType([StructField("_kept", StructType([f for f in docs.schema if f.name in keep]) if keep else IntegerType()), StructField(id_col, docs.schema[id_col].dataType), StructField("score", DoubleType()), StructField("predicted", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables() if net.constant is None else None
        for batch in batches:
            column = batch.column(2) if text_col not in keep else batch.column(0).field(text_col).cast(pa.string())
            got = scores(net, [x.encode("utf-8", "replace") for x in texts(column)], tables)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(got, pa.float64()), pa.array((got >= threshold).astype(np.int32))], names=to.names)

    kept = F.struct(*[F.col(c) for c in docs.columns if c in keep]) if keep else F.lit(None).cast("int")
    text = [] if text_col in keep else [F.col(text_col).cast("string").alias("_text")]
    return docs.select(kept.alias("_kept"), F.col(id_col), *text).mapInArrow(sliced(run), to)


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = 700, max_bytes: int = 6_000_000, max_text: int = 60_000) -> Net:
    """Train on the driver from a bounded sample (see sample)."""
    texts_, y, prior = sample(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, rows=rows, max_bytes=max_bytes, max_text=max_text)
    return train(texts_, y, prior)
