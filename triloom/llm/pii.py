"""Personal data: patterns, and a character-level bidirectional LSTM with CRF transitions in numpy.

The base are four patterns (email, ip, card, phone), applied to the whole text. The model adds spans that the patterns miss,
such as phone numbers without a plus sign; base spans stay. It is trained from labelled spans, which a seeded
generator writes: foreign-looking prose with personal data in many spellings (labelled), and with numbers, versions, keys
and hashes (not labelled). Training data don't depend on the corpus, so the driver trains once and tasks get the weights.

A text is covered by overlapping windows. What counts as personal data holds a digit, an at sign or [at] or (at), so the network
runs on windows with a part of one, and then on each window that meets a span found, until there is no more: the other
windows can't change the result. Each window's best path comes from the CRF (Viterbi). Then the
whole text is reconciled: spans of one kind that overlap in neighbouring windows are joined, of conflicting
kinds the set of greatest total score stays, and what overlaps a base span or isn't plausible for its kind goes.

Defined cases: a null or empty text has no spans; null ids and repeated rows are read row by row; of sets of conflicting spans
with equal scores the one that ends first stays; an empty table gives no rows; further columns are carried only where named. A very
long text costs memory in proportion to its spans and windows.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .runtime import arrow_schema, ddl, sliced, small_batches, texts

KINDS = ("email", "ip", "card", "phone")
# The base patterns. A lookbehind keeps the search for ip linear and starts no match elsewhere.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Each span that `plausible` accepts holds one of these; the longest has MARK characters.
ANCHOR, MARK = re.compile(r"[0-9@]|\[at\]|\(at\)"), 4
DIGITS = str.maketrans("", "", " -().+")

WINDOW, STRIDE, TAGS = 80, 40, 1 + len(KINDS)
VOCABULARY = 130


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by the patterns; each kind leftmost and without overlap, failing matches dropped."""
    out: list[tuple[int, int, int]] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if ANCHOR.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
                out.append((1, *m.span()))
        for m in CARD.finditer(text):
            d = m.group().translate(DIGITS)
            if 16 <= len(d) <= 19 and luhn(d):
                out.append((2, *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                    out.append((3, *m.span()))
    return out


@dataclass
class Tagger:
    """table: per direction, what a character adds to the four gates; inner: hidden to gates; out, out_bias: to tags;
    move [from, to], start: CRF transitions."""

    table: list[np.ndarray]
    inner: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray
    move: np.ndarray
    start: np.ndarray


def codes(text: str) -> np.ndarray:
    """Characters as 0-127, letters beyond ASCII as 128, all else as 129."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return np.where(points < 128, points, np.where(points < 0x2000, 128, 129)).astype(np.int64)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def lstm(table: np.ndarray, inner: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, list]:
    """Hidden states [T, B, H] over x [T, B], and what the way back needs."""
    hs = inner.shape[0]
    h, c, hidden, kept = np.zeros((x.shape[1], hs), np.float32), np.zeros((x.shape[1], hs), np.float32), [], []
    for row in x:
        gates = table[row] + h @ inner
        s = sigmoid(gates[:, : 3 * hs])
        i, f, o, g = s[:, :hs], s[:, hs : 2 * hs], s[:, 2 * hs :], np.tanh(gates[:, 3 * hs :])
        before, prior = c, h
        c = f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        hidden.append(h)
        kept.append((i, f, o, g, before, tc, prior))
    return np.stack(hidden), kept


def lstm_back(inner: np.ndarray, x: np.ndarray, kept: list, dh_all: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    d_table, d_inner = np.zeros((size, inner.shape[1]), np.float32), np.zeros_like(inner)
    dh, dc = np.zeros_like(kept[0][0]), np.zeros_like(kept[0][0])
    for t in range(len(kept) - 1, -1, -1):
        i, f, o, g, before, tc, prior = kept[t]
        dh = dh + dh_all[t]
        dc = dc + dh * o * (1 - tc * tc)
        dg = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        np.add.at(d_table, x[t], dg)
        d_inner += prior.T @ dg
        dh, dc = dg @ inner.T, dc * f
    return d_table, d_inner


def emissions(net: Tagger, x: np.ndarray) -> np.ndarray:
    """Tag scores [T, B, TAGS] of windows x [T, B]."""
    ahead, _ = lstm(net.table[0], net.inner[0], x)
    back, _ = lstm(net.table[1], net.inner[1], x[::-1])
    return np.concatenate([ahead, back[::-1]], axis=2) @ net.out + net.out_bias


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def crf_gradient(net: Tagger, e: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of the mean negative log likelihood by emissions, transitions and start, by forward-backward."""
    T, B, K = e.shape
    alpha, beta = np.zeros_like(e), np.zeros_like(e)
    alpha[0] = net.start + e[0]
    for t in range(1, T):
        alpha[t] = log_sum(alpha[t - 1][:, :, None] + net.move, 1) + e[t]
    for t in range(T - 2, -1, -1):
        beta[t] = log_sum(net.move + (e[t + 1] + beta[t + 1])[:, None, :], 2)
    z = log_sum(alpha[-1], 1)
    de = np.exp(alpha + beta - z[None, :, None])
    pairs = np.exp(alpha[:-1, :, :, None] + net.move + (e[1:] + beta[1:])[:, :, None, :] - z[None, :, None, None]).sum(axis=(0, 1))
    np.add.at(pairs, (y[:-1].ravel(), y[1:].ravel()), -1)
    np.add.at(de, (np.arange(T)[:, None], np.arange(B)[None, :], y), -1)
    return de / B, pairs / B, de[0].sum(axis=0) / B


def viterbi(net: Tagger, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best tags [T, B], and how far each chosen tag's score lies above that of no personal data [T, B]."""
    T, B, _ = e.shape
    best, back = net.start + e[0], np.zeros(e.shape, np.int64)
    for t in range(1, T):
        way = best[:, :, None] + net.move
        back[t] = way.argmax(axis=1)
        best = way.max(axis=1) + e[t]
    tags = np.zeros((T, B), np.int64)
    tags[-1] = best.argmax(axis=1)
    for t in range(T - 1, 0, -1):
        tags[t - 1] = back[t][np.arange(B), tags[t]]
    return tags, np.take_along_axis(e, tags[:, :, None], 2)[:, :, 0] - e[:, :, 0]


SYLLABLES = "the er in on at ed re st en or ti he th and of to ha sh bl ing ent ion eau oi aux que lle de la ch ge ung keit sch ver pf ado ci os ar ll rr za mo ña é ü ç ö ß".split()


def example(rng: np.random.Generator, length: int) -> tuple[str, np.ndarray]:
    """Labelled characters: prose with spans of each kind, and with what only looks like them."""
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    num = lambda n: "".join(str(d) for d in rng.integers(0, 10, n))
    word = lambda: "".join(pick(SYLLABLES) for _ in range(int(rng.integers(1, 5))))

    def card() -> str:
        digits = "4" + num(14)
        digits += next(c for c in "0123456789" if luhn(digits + c))
        sep = pick(["", "", " ", "-"])
        return sep.join(digits[k : k + 4] for k in range(0, 16, 4))

    def phone() -> str:
        a, b, c = num(3), num(3), num(4)
        return pick([f"+1 ({a}) {b}-{c}", f"+{pick(['49', '33', '34', '1'])} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"({a}) {b} {c}", f"+1-{a}-{b}-{c}", f"{a}.{b}.{c}"])

    def email() -> str:
        name, host = pick([word(), f"{word()}.{num(2)}", f"{word()}_{word()}"]), pick([f"mail{num(1)}.example.com", f"{word()}.org", f"{word()}.example.net"])
        return pick([f"{name}@{host}", f"{name}@{host}", f"{name} @ {host}", f"{name} [at] {host.replace('.', ' [dot] ')}"])

    def ip() -> str:
        return pick(["{}.{}.{}.{}", "{}.{}.{}.{}", "{}[.]{}[.]{}[.]{}"]).format(*rng.integers(1, 256, 4))

    def other() -> str:
        return pick([num(3), num(4), f"{num(1)}.{num(1)}", f"v{num(1)}.{num(2)}.{num(1)}", "AKIA" + "".join(pick("ABCDEFGHJKLMNPQRSTUVWXYZ234567") for _ in range(16)), "".join(pick("0123456789abcdef") for _ in range(40)), f"{num(4)}-{num(2)}-{num(2)}", f"{num(2)}:{num(2)}", num(6), f"${num(3)}.{num(2)}", f"{num(1)},{num(3)}", f"@{word()}", num(20), num(9), f"{num(2)}%", f'"{num(12)}"', f"({num(3)})", f"{num(3)}-{num(3)}", "***", "!!", "| ", f"{word()}{num(2)}"])

    parts: list[tuple[str, int]] = []
    size = 0
    while size < 2 * length:
        x = rng.random()
        kind = int(rng.integers(1, 5)) if x < 0.12 else 0
        token = (email, ip, card, phone)[kind - 1]() if kind else other() if x < 0.26 else word() + pick(["", "", "", ".", ","])
        parts += [(token, kind), (pick([" ", " ", " ", " ", "\n"]) if x > 0.01 else "", 0)]
        size += len(token) + 1
    text = "".join(t for t, _ in parts)
    tags = np.concatenate([np.full(len(t), k) for t, k in parts])
    at = int(rng.integers(0, len(text) - length))
    return text[at : at + length], tags[at : at + length]


@functools.lru_cache(maxsize=2)
def train(seed: int = 11, steps: int = 800, batch: int = 48, hidden: int = 16, embed: int = 8, rate: float = 0.02) -> Tagger:
    """Adam on the CRF's likelihood over generated examples."""
    rng = np.random.default_rng(seed)
    w = lambda *s: rng.normal(0, 0.3, s).astype(np.float32)
    p = {"embed": w(VOCABULARY, embed), "out": w(2 * hidden, TAGS), "out_bias": np.zeros(TAGS, np.float32), "move": np.eye(TAGS, dtype=np.float32), "start": np.zeros(TAGS, np.float32)}
    for d in range(2):
        p |= {f"x{d}": w(embed, 4 * hidden), f"inner{d}": w(hidden, 4 * hidden), f"bias{d}": np.repeat(np.array([0, 1, 0, 0], np.float32), hidden)}
    mean, square = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    pool = [example(rng, WINDOW) for _ in range(3000)]
    xs, ys = np.array([codes(t) for t, _ in pool]), np.array([y for _, y in pool])

    def net() -> Tagger:
        return Tagger([p["embed"] @ p[f"x{d}"] + p[f"bias{d}"] for d in range(2)], [p["inner0"], p["inner1"]], p["out"], p["out_bias"], p["move"], p["start"])

    for step in range(1, steps + 1):
        take = rng.integers(0, len(xs), batch)
        x, y = np.ascontiguousarray(xs[take].T), np.ascontiguousarray(ys[take].T)
        now = net()
        ahead, kept0 = lstm(now.table[0], now.inner[0], x)
        back, kept1 = lstm(now.table[1], now.inner[1], x[::-1])
        h = np.concatenate([ahead, back[::-1]], axis=2)
        de, g_move, g_start = crf_gradient(now, h @ now.out + now.out_bias, y)
        de = de.astype(np.float32)
        g = {"move": g_move, "start": g_start, "out": np.einsum("tbh,tbk->hk", h, de), "out_bias": de.sum(axis=(0, 1))}
        dh = de @ now.out.T
        hs = now.inner[0].shape[0]
        g["embed"] = np.zeros_like(p["embed"])
        for d, (kept, xx, dd) in enumerate(((kept0, x, dh[:, :, :hs]), (kept1, x[::-1], dh[::-1, :, hs:]))):
            d_table, g[f"inner{d}"] = lstm_back(now.inner[d], xx, kept, dd, VOCABULARY)
            g[f"x{d}"], g[f"bias{d}"] = p["embed"].T @ d_table, d_table.sum(axis=0)
            g["embed"] += d_table @ p[f"x{d}"].T
        norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        lr = rate * min(1, 2 * (1 - step / (steps + 1))) * min(1.0, 5 / (norm + 1e-9))
        for k in p:
            mean[k] += 0.1 * (g[k] - mean[k])
            square[k] += 0.01 * (g[k] * g[k] - square[k])
            p[k] -= (lr * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net()


def last_window(text: str) -> int:
    return max(0, -(-(len(text) - WINDOW) // STRIDE))


def windows(text: str) -> list[int]:
    """Starts of the windows that hold an anchor or a part of one; windows lie STRIDE apart and cover the text."""
    out: list[int] = []
    last = last_window(text)
    m = ANCHOR.search(text)
    while m:
        low, high = max(0, -(-(m.start() - WINDOW + 1) // STRIDE)), min(last, (m.end() - 1) // STRIDE)
        out += range(max(low, out[-1] + 1) if out else low, high + 1)
        # the windows up to `high` are in; the next anchor that matters reaches into one after it
        m = ANCHOR.search(text, max(m.start() + 1, (high + 1) * STRIDE - MARK + 1)) if high < last else None
    return [k * STRIDE for k in out]


def plausible(kind: int, span: str) -> bool:
    """Whether a span found by the model can be what the model takes it for."""
    digits = "".join(c for c in span if "0" <= c <= "9")
    if kind == 0:
        return bool(re.fullmatch(r"[\w.%+-]+ ?(?:@|\[at\]|\(at\)) ?[\w-]+(?: ?(?:\.|\[dot\]|\(dot\)) ?[\w-]+)+", span.replace(" [at] ", "[at]").replace(" [dot] ", "[dot]")))
    if kind == 1:
        parts = re.split(r"[^0-9]+", span)
        return len(parts) == 4 and all(p and int(p) <= 255 for p in parts if len(p) < 9) and all(0 < len(p) < 4 for p in parts)
    if kind == 2:
        return 16 <= len(digits) <= 19 and luhn(digits) and len(span) <= 2 * len(digits)
    return 8 <= len(digits) <= 15 and bool(re.fullmatch(r"\+?[0-9(][0-9() .-]*[0-9]", span)) and len(re.findall(r"[0-9]+", span)) >= 3


def reconcile(text: str, found: list[tuple[int, int, int, float]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans to add to the base: found are (kind, start, end, score) from all windows of a text."""
    joined: list[list] = []
    for kind, start, end, score in sorted(found):
        if joined and joined[-1][0] == kind and start <= joined[-1][2]:
            joined[-1][2], joined[-1][3] = max(end, joined[-1][2]), max(score, joined[-1][3])
        else:
            joined.append([kind, start, end, score])
    base = sorted((a, b) for _, a, b in base)
    begins, reach = [a for a, _ in base], list(itertools.accumulate((b for _, b in base), max))
    fit = []
    for kind, start, end, score in joined:
        while start < end and text[start] in " \n\t.,;:":
            start += 1
        while end > start and text[end - 1] in " \n\t.,;:":
            end -= 1
        inside = start > 0 and text[start - 1].isalnum() or end < len(text) and text[end].isalnum()
        before = bisect.bisect_left(begins, end)  # base spans that begin before the end; does one of them reach in?
        meets = before > 0 and reach[before - 1] > start
        if start < end and not inside and not meets and ANCHOR.search(text, start, end) and plausible(kind, text[start:end]):
            fit.append((end, start, kind, score))
    fit.sort()
    ends = [f[0] for f in fit]
    # of overlapping spans, the set of greatest total score; back has, for each span, where the set goes on if the span is taken
    best, back = [0.0], []
    for k, (_, start, _, score) in enumerate(fit):
        j = bisect.bisect_right(ends, start, 0, k)
        back.append(j if best[j] + score > best[-1] else -1)
        best.append(max(best[-1], best[j] + score))
    out, k = [], len(fit)
    while k:
        if back[k - 1] < 0:
            k -= 1
        else:
            end, start, kind, _ = fit[k - 1]
            out.append((kind, start, end))
            k = back[k - 1]
    return out[::-1]


def added_spans(net: Tagger, batch: list[str], bases: list[list[tuple[int, int, int]]], group: int = 512) -> list[list[tuple[int, int, int]]]:
    """For each text, the model's spans beyond the base ones."""
    jobs = [(k, s) for k, t in enumerate(batch) for s in windows(t)]
    seen = set(jobs)
    found: list[list] = [[] for _ in batch]
    while jobs:
        more: list[tuple[int, int]] = []
        for at in range(0, len(jobs), group):
            part = jobs[at : at + group]
            x = np.full((WINDOW, len(part)), 10)
            for b, (k, s) in enumerate(part):
                c = codes(batch[k][s : s + WINDOW])
                x[: len(c), b] = c
            tags, margin = viterbi(net, emissions(net, x))
            for b in np.flatnonzero(tags.any(axis=0)):
                k, s = part[b]
                t, edges = tags[:, b], np.flatnonzero(np.diff(np.concatenate([[0], tags[:, b], [0]])))
                for u, v in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    if t[u]:
                        start, end = s + u, min(s + v, len(batch[k]))
                        found[k].append((int(t[u]) - 1, start, end, float(margin[u:v, b].sum())))
                        # all windows that the span overlaps or touches
                        near = range(max(0, -(-(start - WINDOW) // STRIDE)), min(last_window(batch[k]), end // STRIDE) + 1)
                        more += [(k, w * STRIDE) for w in near if (k, w * STRIDE) not in seen]
                        seen.update((k, w * STRIDE) for w in near)
        jobs = more
    return [reconcile(t, f, base) if f else [] for t, f, base in zip(batch, found, bases, strict=True)]


def named(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find(docs: DataFrame, net: Tagger, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone (base), base_sha256 and spans (base and model's)."""
    small_batches(docs.sparkSession)
    schema = arrow_schema(doc_id="long", n_email="long", n_ip="long", n_card="long", n_phone="long", base_sha256="string", spans="string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = texts(batch.column(1))
            bases = [base_spans(t) for t in text]
            more = added_spans(net, text, bases)
            counts = [pa.array([sum(s[0] == k for s in b) for b in bases], pa.int64()) for k in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array([hashlib.sha256(named(b).encode()).hexdigest() for b in bases]), pa.array([named(b + m) for b, m in zip(bases, more, strict=True)])], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(sliced(run), ddl(schema))


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping spans by that of the first."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = end
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, net: Tagger, *, text_col: str = "text") -> DataFrame:
    """The same rows and columns, with personal data in the text masked; a null text stays null."""
    small_batches(docs.sparkSession)
    names = docs.columns
    to = StructType([StructField(text_col, StringType()) if f.name == text_col else f for f in docs.schema.fields])
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column(at).to_pylist()
            text = ["" if t is None else t for t in given]
            bases = [base_spans(t) for t in text]
            clean = [None if g is None else masked(g, b + m) if b or m else g for g, b, m in zip(given, bases, added_spans(net, text, bases), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(clean, pa.string()), *batch.columns[at + 1 :]], names=names)

    return docs.mapInArrow(sliced(run), to)
