"""Packing by power-of-two decomposition.

Each document's token ids, closed by an end id, are cut into pieces whose lengths are powers of two: as many
full pieces as fit, then the binary digits of the rest from the highest to the lowest. Each piece is a sequence
of its own, in the bucket of its length; all sequences of a bucket have equal length, none crosses documents,
and none needs padding.

Defined cases: a null or empty text is the end id alone (one piece of length 1); a special token spelt out in a text has its own id, as the
tokenizer has it; a very long text is one row in a worker; a null id, repeated rows and
ties pack row by row; an empty table gives no rows; further columns of the input are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import arrow_schema, ddl, sliced, small_batches, texts

#: Distinct words whose ids one Python worker remembers.
CACHE_WORDS = 700_000
#: A word of the vocabulary that stands between others.
MARK = b"amazon"
_WORDS: dict[str, dict[str, bytes]] = {}
_TOKENIZERS: dict = {}


def tokenizers(path: str) -> tuple:
    """The tokenizer, its special tokens, and the MARK's id or None."""
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        one = Tokenizer.from_file(path)
        mark = one.encode(MARK.decode(), add_special_tokens=False).ids
        _TOKENIZERS[path] = one, [t.content.encode() for t in one.get_added_tokens_decoder().values()], mark[0] if len(mark) == 1 else None
    return _TOKENIZERS[path]


def word_ids(path: str, words: set[bytes]) -> dict[bytes, bytes]:
    """Ids of each word (UTF-8) as little-endian unsigned 32-bit integers, from a cache that lasts as long as the worker.

    The vocabulary's normaliser and pre-tokeniser never join across ASCII white space, so a text's ids are those
    of its words.
    """
    known = _WORDS.setdefault(path, {})
    new = words.difference(known)
    if not new:
        return known
    if len(known) + len(new) > CACHE_WORDS:
        known.clear()
        new = words
    tokenizer, special, mark = tokenizers(path)
    tokenizer.encode_special_tokens = False
    plain, apart = list(new), []
    # what spells the mark or a special token goes alone, if anything does
    joined = b"\n".join(plain)
    if mark is None:
        plain, apart = [], plain
    elif MARK in joined.lower() or any(t in joined for t in special):
        alone = [MARK in w.lower() or any(t in w for t in special) for w in plain]
        plain, apart = ([w for w, x in zip(plain, alone, strict=True) if x == y] for y in (False, True))
    for w, got in zip(apart, tokenizer.encode_batch_fast([w.decode() for w in apart], add_special_tokens=False), strict=True):
        known[w] = np.asarray(got.ids, "<u4").tobytes()
    # many words in one call, with a word between them whose one id they can't hold; none has a special token, so it needn't look for them
    tokenizer.encode_special_tokens = True
    groups = [plain[at : at + 500] for at in range(0, len(plain), 500)]
    for part, got in zip(groups, tokenizer.encode_batch_fast([(b" " + MARK + b" ").join(g).decode() for g in groups], add_special_tokens=False), strict=True):
        ids = np.asarray(got.ids, "<u4")
        cuts = 4 * np.flatnonzero(ids == mark)
        raw = ids.tobytes()
        known.update(zip(part, [raw[a:b] for a, b in zip([0, *(cuts + 4).tolist()], [*cuts.tolist(), len(raw)], strict=True)], strict=True))
    return known


def document_ids(path: str, batch: list[str], group: int = 2_000_000) -> Iterator[bytes]:
    """Ids of each text, in order; texts are taken in groups of about so many characters."""
    at = 0
    while at < len(batch):
        end, size = at, 0
        while end < len(batch) and (end == at or size + len(batch[end]) <= group):
            size += len(batch[end])
            end += 1
        # ASCII white space only: encoding to bytes first makes split() use just that
        split = [x.encode("utf-8", "replace").split() for x in batch[at:end]]
        known = word_ids(path, set().union(*split))
        for ws in split:
            yield b"".join(map(known.__getitem__, ws))
        at = end


def pieces(n: int, longest: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of n ids; longest is a power of two."""
    start = 0
    for _ in range(n // longest):
        yield start, longest
        start += longest
    rest, size = n - start, longest >> 1
    while rest:
        if rest >= size:
            yield start, size
            start, rest = start + size, rest - size
        size >>= 1


def pack(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", longest: int = 2048, end_id: int = 1, keep_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket and, with
    keep_ids, the ids as little-endian unsigned 32-bit integers. sequence_id is the partition's number times 2^36
    plus a running number, so it needs no shuffle. longest must be a power of two."""
    small_batches(docs.sparkSession)
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    kinds = {"doc_id": "long", "start": "long", "length": "long", "ids_crc32": "long", "doc_tokens": "long", "sequence_id": "long", "offset": "long", "bucket": "int"}
    schema = arrow_schema(**kinds, **({"ids": "binary"} if keep_ids else {}))
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 36
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            for doc, ids in zip(batch.column(0).to_pylist(), document_ids(tokenizer, texts(batch.column(1))), strict=True):
                ids += end
                n = len(ids) // 4
                for start, length in pieces(n, longest):
                    part = ids[4 * start : 4 * (start + length)]
                    row = (doc, start, length, zlib.crc32(part), n, sequence, 0, length, part)
                    for column, value in zip(out, row):
                        column.append(value)
                    sequence += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(sliced(run), ddl(schema))
