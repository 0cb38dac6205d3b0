"""Byte-level BPE encoding and decoding with DuckDB recursive queries inside each partition.

A text is cut into runs of non-space characters with at most one blank before each, and runs of white space; a
match of the vocabulary's pattern never crosses such a cut, so the runs not met before are matched and their words
go to DuckDB. There each word's bytes are rows of token positions. A recursive query joins neighbours to the merge
table and contracts each word's leftmost pair of least rank, until no pair is in the table. An ordered aggregation turns
the rows left to ids, and the ids back to bytes.

Defined cases: a null or empty text has no ids; null ids and repeated rows are encoded row by row; an empty table
gives no rows; further columns are ignored. Texts are never cut short; a very long word takes as many steps as it
has different merges. A worker holds an Arrow batch of texts and the memory of runs and words.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import arrow_schema, ddl, sliced, small_batches, texts

#: White space as the vocabulary's pattern has it (the Unicode property), whatever a regex library takes \s for.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
RUNS = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: Runs and words whose ids one Python worker remembers, bytes of words in one query, and DuckDB's memory.
CACHE_RUNS, QUERY_BYTES, MEMORY = 1_000_000, 500_000, "300MB"

#: Words of one query; they come sorted by length, so that all of a query take about as many steps.
QUERY_WORDS = 32_000
#: What is left of a word, and the bytes of its tokens, by ordered aggregation of its token-position rows.
ENDS = """
select word, list({'id': token, 'bytes': v.bytes} order by pos) as tokens
from ended join vocabulary v on v.rank = ended.token group by word
"""
#: Token-position rows meet the merge table: each position gets the rank of the pair that starts there. Words then go through the
#: recursion with their tokens and ranks in order; a step contracts the leftmost pair of least rank (none: 2000000000), and the
#: pairs that begin before and at the new token join the merge table. A word without a pair in the table comes back no more.
SHORT = """
with recursive state(word, t, r) as (
    select word, list(token order by pos), list(coalesce(m.rank, 2000000000) order by pos)
    from start s left join merges m on m.a = s.token and m.b = s.ntok group by word
  union all
    select h.word, t[1:i - 1] || [made] || t[i + 2:],
      t2[1:greatest(i - 2, 0)] || (case when i > 1 then [coalesce(l.rank, 2000000000)] else []::int[] end) || [coalesce(m.rank, 2000000000)] || t2[i + 2:]
    from (select word, t, r as t2, least as made, list_position(r, least) as i from (select *, list_min(r) as least from state) where least < 2000000000) h
    left join merges l on l.a = t[i - 1] and l.b = made
    left join merges m on m.a = made and m.b = t[i + 2]
), ended as (
    select word, unnest(t) as token, unnest(range(len(t))) as pos from state where list_min(r) = 2000000000
)""" + ENDS
#: The same with one row for each position, for words of any length: all places of the pair of least rank that don't overlap, from the
#: left, at once. A pair with the new token ranks higher than the pair itself, so this is what one place at a time comes to.
#: nxt and ntok are the position and token of the right neighbour, rank that of the pair; a contracted neighbour stays
#: as a row with token -1.
LONG_WORDS = """
with recursive state(word, pos, token, nxt, ntok, rank) using key (word, pos) as (
    select s.*, m.rank from start s left join merges m on m.a = s.token and m.b = s.ntok
  union
    select * from (
      with hit as (
        select word, pos, rank as made from (
          select *, row_number() over (partition by word, run order by pos) as nth from (
            select *, sum(fresh) over (partition by word order by pos) as run from (
              select s.word, s.pos, s.rank, case when lag(s.nxt) over (partition by s.word order by s.pos) = s.pos then 0 else 1 end as fresh
              from recurring.state s join (select word, min(rank) as least from recurring.state where rank is not null group by word) l
              on l.word = s.word and l.least = s.rank))) where nth % 2 = 1),
      ends as (select h.word, h.pos, h.made, r.nxt as gone from hit h join recurring.state r on r.word = h.word and r.pos = h.pos),
      far as (
        select e.word, e.pos, e.made, e.gone, r.nxt, coalesce(h.made, r.ntok) as ntok
        from ends e join recurring.state r on r.word = e.word and r.pos = e.gone left join hit h on h.word = e.word and h.pos = r.nxt),
      changed as (
        select word, pos, made as token, nxt, ntok from far
        union all
        select f.word, r.pos, r.token, r.nxt, f.made from far f join recurring.state r on r.word = f.word and r.nxt = f.pos
        where r.token >= 0 and not exists (select 1 from ends g where g.word = r.word and (g.gone = r.pos or g.pos = r.pos)))
      select c.*, m.rank from changed c left join merges m on m.a = c.token and m.b = c.ntok
      union all
      select word, gone, -1, -2, -1, null from far)
), ended as (select word, pos, token from state where token >= 0)""" + ENDS
#: Bytes of a word that counts as long.
LONG = 64


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Encoder:
    """A vocabulary in DuckDB, and a bounded memory of runs."""

    def __init__(self, path: str, pattern: str):
        import duckdb

        self.pattern = regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]"))
        ranks = load_ranks(path)
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        # every split of a token into two tokens merges to it
        merges = [(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": MEMORY, "preserve_insertion_order": False})
        columns = [pa.array(x, pa.int32()) for x in zip(*merges, strict=True)]
        self.put("merges", pa.table(columns, names=["a", "b", "rank"]))
        self.put("vocabulary", pa.table({"rank": pa.array(ranks.values(), pa.int32()), "bytes": pa.array(ranks.keys(), pa.binary())}))
        self.ids: dict[str, bytes] = {}
        self.spelt: dict[str, bytes] = {}

    def put(self, name: str, table: pa.Table) -> None:
        self.db.register("given", table)
        self.db.execute(f"create or replace table {name} as select * from given")
        self.db.unregister("given")

    def words(self, words: list[bytes]) -> tuple[list[bytes], list[bytes]]:
        """Of words that come sorted by length, their ids as little-endian unsigned 32-bit integers, and the bytes that they decode to."""
        ids_of: list[bytes] = []
        spelt_of: list[bytes] = []
        at = 0
        while at < len(words):
            end, size, long = at, 0, len(words[at]) > LONG
            while end < len(words) and end < at + QUERY_WORDS and (end == at or (size + len(words[end]) <= QUERY_BYTES and (len(words[end]) > LONG) == long)):
                size += len(words[end])
                end += 1
            part, at = words[at:end], end
            lengths = np.fromiter(map(len, part), np.int64, len(part))
            word, starts = np.repeat(np.arange(len(part), dtype=np.int32), lengths), np.cumsum(lengths) - lengths
            pos = (np.arange(size) - np.repeat(starts, lengths)).astype(np.int32)
            token = self.single[np.frombuffer(b"".join(part), np.uint8)]
            last = pos == np.repeat(lengths, lengths) - 1
            self.put("start", pa.table({"word": word, "pos": pos, "token": token, "nxt": np.where(last, -1, pos + 1).astype(np.int32), "ntok": np.where(last, -1, np.append(token[1:], -1)).astype(np.int32)}))
            got = self.db.sql(LONG_WORDS if long else SHORT).to_arrow_table().combine_chunks()
            got = got.take(np.argsort(got["word"].to_numpy())).combine_chunks()
            tokens = got["tokens"].chunk(0)
            ids, spelt = (tokens.values.field(k) for k in range(2))
            at_ids = np.asarray(tokens.offsets)
            at_bytes = np.frombuffer(spelt.buffers()[1], np.int32, len(spelt) + 1, 4 * spelt.offset)[at_ids].tolist()
            at_ids = (4 * at_ids).tolist()
            flat, data = np.asarray(ids).astype("<u4").tobytes(), spelt.buffers()[2].to_pybytes()
            ids_of += [flat[a:b] for a, b in zip(at_ids[:-1], at_ids[1:], strict=True)]
            spelt_of += [data[a:b] for a, b in zip(at_bytes[:-1], at_bytes[1:], strict=True)]
        return ids_of, spelt_of

    def learn(self, new: set[str]) -> None:
        """Runs, and the words that they have in common, are kept in one memory."""
        ids, spelt = self.ids, self.spelt
        # letters after at most one blank are one match
        cut = {run: self.pattern.findall(run) for run in new if not (run.isalpha() or run[0] == " " and run[1:].isalpha())}
        fresh = sorted(((w.encode("utf-8", "replace"), w) for w in set().union(*cut.values()).union(new.difference(cut)).difference(ids)), key=lambda x: len(x[0]))
        for known, found in zip((ids, spelt), self.words([b for b, _ in fresh]), strict=True):
            known.update(zip([w for _, w in fresh], found, strict=True))
        for run, ws in cut.items():
            if len(ws) > 1:
                ids[run], spelt[run] = b"".join(map(ids.__getitem__, ws)), b"".join(map(spelt.__getitem__, ws))

    def encode(self, batch: list[str], group: int = 4_000_000) -> Iterator[tuple[bytes, bytes]]:
        """Ids and decoded bytes of each text, in order."""
        at = 0
        while at < len(batch):
            end, size = at, 0
            while end < len(batch) and (end == at or size + len(batch[end]) <= group):
                size += len(batch[end])
                end += 1
            cut = list(map(RUNS.findall, batch[at:end]))
            distinct = set().union(*cut)
            new = distinct.difference(self.ids)
            if len(self.ids) + len(new) > CACHE_RUNS:
                self.ids.clear()
                self.spelt.clear()
                new = distinct
            if new:
                self.learn(new)
            for runs in cut:
                yield b"".join(map(self.ids.__getitem__, runs)), b"".join(map(self.spelt.__getitem__, runs))
            at = end


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """The worker's encoder; building one takes a second, so it outlives the task."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(path, pattern)
    return _ENCODERS[path, pattern]


def encode(docs: DataFrame, ranks: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256 and, with keep_ids, ids and decoded bytes."""
    small_batches(docs.sparkSession)
    schema = arrow_schema(doc_id="long", n_tokens="long", ids_sha256="string", decoded_sha256="string", **({"ids": "binary", "decoded": "binary"} if keep_ids else {}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            enc = encoder(ranks, pattern)
            out: list[list] = [[] for _ in schema]
            for doc, (ids, back) in zip(batch.column(0).to_pylist(), enc.encode(texts(batch.column(1))), strict=True):
                row = (doc, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest(), ids, back)
                for column, value in zip(out, row):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(sliced(run), ddl(schema))
