"""Harmonic packing of token sequences.

A document's ids are cut by its length alone: into whole sequences, then into pieces that fill a reciprocal share of one
(a half, a third, ...) exactly or nearly so, and a short rest. Pieces of class k are longer than capacity / (k + 1) and at most
capacity / k, so any k of them fit: every worker fills the bins of a class with k pieces each, in the order in which they
come, and needs to know nothing of other workers or classes. Bins that a worker leaves open are few, whatever it has read:
their pieces are numbered over all workers by counts, fill bins of k again, and what then is left of all classes (fewer
than k pieces of each) is laid end to end and cut at the capacity.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sieveline.llm.common import materialize, small_batches, table

CAPACITY, END, VOCABULARY = 2048, 1, "word_bpe_49k.json"
#: A piece is not cut if it leaves free at most this share of its class's share, nor below this share of a sequence.
FREE, SHORT = 1 / 64, 1 / 16
#: Words whose ids a worker keeps (twice as many at most), the bytes of a word that it keeps, new words encoded at once;
#: bytes of text that are split at once, bytes of ids in one batch of pieces.
KEPT_WORDS, KEPT_BYTES, ENCODED, IN_BYTES, OUT_BYTES = 300_000, 64, 1000, 2 << 20, 4 << 20
#: Words of printable ASCII and the accented letters of U+00C0 to U+00FF, and their pre-tokens in lower case. Fixed
#: values: the pattern of the tokenizer's file.
_PLAIN = re.compile(rb"(?:[\x21-\x7E]|\xC3[\x80-\x96\x98-\xB6\xB8-\xBF])+").fullmatch
_PRE_TOKENS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+").findall
#: Sequence numbers: workers number theirs from their own place, bins of the rest have the highest bit but the sign's.
_WORKER, _REST = 40, 1 << 62

PIECES = "doc_id string, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, class int, worker long, place long"


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """The lengths of n ids' pieces, in order, with their classes."""
    whole, rest = divmod(n, capacity)
    out = [(capacity, 1)] * whole
    while rest:
        k = capacity // rest
        if rest <= capacity * SHORT or rest >= (capacity // k) * (1 - FREE):
            out.append((rest, k))
            break
        piece = capacity // (k + 1)
        out.append((piece, capacity // piece))
        rest -= piece
    return out


class _Words:
    """A tokenizer that keeps the ids of words. Its pre-tokens never span white space, so a text's ids are its words'.

    Words that were met lately are in one dictionary, those of before in another: what is met again moves over, and when
    the first is full the second is forgotten. New words are encoded many at a time, as one text, and told apart by the
    places of their tokens."""

    def __init__(self, file: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task for each core
        from tokenizers import Tokenizer

        self.tokenizer, self.late, self.before = Tokenizer.from_buffer(file), {}, {}
        own = [re.escape(t.content.encode("utf-8")) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = re.compile(b"|".join(own) or b"(?!)").search  # tokens that no pattern cuts

    def _encoded(self, words: list[str]) -> Iterator[bytes]:
        e = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        begins = np.cumsum([0, *(len(w) + 1 for w in words)])
        cut = (4 * np.searchsorted(np.array([o for o, _ in e.offsets], np.int64), begins)).tolist()
        ids = np.array(e.ids, "<u4").tobytes()
        return (ids[i:j] for i, j in zip(cut, cut[1:], strict=False))

    def _learn(self, new: set[bytes]) -> None:
        """Ids of new words. Plain words are cut into the tokenizer's pre-tokens first, which many words share."""
        rows, parts = {}, set()
        for w in new:
            if _PLAIN(w) and not self.whole(w):
                rows[w] = cut = [p.encode("utf-8") for p in _PRE_TOKENS(w.decode("utf-8").lower())]
                parts.update(cut)
            else:
                parts.add(w)
        parts = parts.difference(self.late)  # looks parts up; difference_update would pass over all that is kept
        for w in self.before.keys() & parts:
            self.late[w] = self.before[w]
            parts.discard(w)
        some = list(parts)
        for at in range(0, len(some), ENCODED):
            part = some[at : at + ENCODED]
            self.late.update(zip(part, self._encoded([w.decode("utf-8") for w in part]), strict=True))
        get = self.late.__getitem__
        for w, cut in rows.items():
            if len(cut) > 1 or cut[0] != w:
                self.late[w] = b"".join(map(get, cut))

    def ids(self, texts: list[bytes]) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text in UTF-8."""
        words = [t.split() for t in texts]  # at space and U+0009 to U+000D
        if len(self.late) > KEPT_WORDS:
            self.late, self.before = {}, self.late
        late, before = self.late, self.before
        new = set().union(*words).difference(late)
        for w in before.keys() & new:
            late[w] = before[w]
        new.difference_update(late)
        self._learn(new)
        found = late.__getitem__
        for ws in words:
            yield b"".join(map(found, ws))
        for w in new:
            if len(w) > KEPT_BYTES:
                late.pop(w, None)


_words: dict[int, _Words] = {}


def _worker_words(file: bytes) -> _Words:
    """One tokenizer a worker, whatever tasks it runs."""
    key = zlib.crc32(file)
    if key not in _words:
        _words.clear()
        _words[key] = _Words(file)
    return _words[key]


def _slices(b: pa.RecordBatch) -> Iterator[tuple[list, list[bytes]]]:
    """The ids and texts of a batch's documents, some at a time."""
    names, texts, size = [], [], 0
    for name, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
        names.append(name)
        texts.append(t or b"")
        size += len(texts[-1])
        if size > IN_BYTES:
            yield names, texts
            names, texts, size = [], [], 0
    if names:
        yield names, texts


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "int": pa.int32()}
    fields = [pa.field(n, kinds[t]) for n, t in (c.split() for c in PIECES.split(", "))]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=pa.schema(fields))


def packed_pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Pieces of all documents: doc_id, start (ids of the document before it), length, ids (binary, little-endian 32-bit),
    doc_tokens, sequence_id, offset (in the sequence, gapless from 0).

    Null and empty texts are the end id alone; a null doc_id is one like any other; repeated rows are packed one by one;
    a text of any length is encoded in a task as a whole and cut into as many pieces as it needs. Other columns are not
    read. An empty table gives no piece."""
    spark = docs.sparkSession
    small_batches(spark)
    with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
        file = spark.sparkContext.broadcast(f.read())  # the size of a vocabulary
    last, width = struct.pack("<I", end), 4

    def fill(batches):
        words, worker, filled = _worker_words(file.value), TaskContext.get().partitionId(), 0
        open_: dict[int, list[tuple]] = {}
        rows: list[tuple] = []
        size = 0
        for b in batches:
            for names, texts in _slices(b):
                for name, ids in zip(names, words.ids(texts), strict=True):
                    ids += last
                    n, start = len(ids) // width, 0
                    for length, k in cuts(n, capacity):
                        bin_ = open_.setdefault(k, [])
                        bin_.append((name, start, length, ids[start * width : (start + length) * width], n))
                        start += length
                        if len(bin_) == k:
                            offset = 0
                            for piece in bin_:
                                rows.append((*piece, (worker << _WORKER) + filled, offset, k, worker, None))
                                offset += piece[2]
                            size += offset * width
                            filled += 1
                            open_[k] = []
                if size > OUT_BYTES:
                    yield _batch(rows)
                    rows, size = [], 0
        rows += [(*piece, None, None, k, worker, i) for k, bin_ in open_.items() for i, piece in enumerate(bin_)]
        if rows:
            yield _batch(rows)

    kind = docs.schema[doc_id].dataType.simpleString()
    named = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text"))
    pieces = materialize(named.mapInArrow(fill, PIECES).withColumn("doc_id", F.col("doc_id").cast(kind)), "packing-pieces")
    out = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    return pieces.filter("sequence_id is not null").select(*out).union(_rest(pieces.filter("sequence_id is null"), capacity).select(*out))


def _before(c: str, by: Window) -> Column:
    return F.coalesce(F.sum(c).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _rest(open_: DataFrame, capacity: int) -> DataFrame:
    """Sequences of the pieces that workers left in open bins."""
    counts = materialize(open_.groupBy("class", "worker").agg(F.count(F.lit(1)).alias("n")), "packing-counts")  # a row a worker and class
    numbered = counts.withColumn("first", _before("n", Window.partitionBy("class").orderBy("worker")))
    numbered = numbered.withColumn("all", F.sum("n").over(Window.partitionBy("class"))).drop("n")
    open_ = open_.drop("sequence_id", "offset").join(numbered, ["class", "worker"])
    open_ = materialize(open_.withColumns({"number": F.col("first") + F.col("place"), "bin": F.floor((F.col("first") + F.col("place")) / F.col("class"))}), "packing-open")
    full = F.col("bin") < F.floor(F.col("all") / F.col("class"))
    sequence = F.lit(_REST) + F.col("class").cast("long") * (1 << _WORKER) + F.col("bin")
    binned = open_.filter(full).withColumn("sequence_id", sequence).withColumn("offset", _before("length", Window.partitionBy("class", "bin").orderBy("number")))
    # fewer than k pieces of class k: their places on one line are those in their class and those of the classes before
    left = open_.filter(~full).withColumn("at", _before("length", Window.partitionBy("class").orderBy("number")))
    base = left.groupBy("class").agg(F.sum("length").alias("total")).withColumn("base", _before("total", Window.orderBy("class"))).select("class", "base")  # a row a class
    left = left.join(base, "class").withColumn("at", F.col("at") + F.col("base")).drop("base")
    line = left.withColumn("bin", F.explode(F.sequence(F.floor(F.col("at") / capacity), F.floor((F.col("at") + F.col("length") - 1) / capacity))))
    lo, hi = F.greatest("at", F.col("bin") * capacity), F.least(F.col("at") + F.col("length"), (F.col("bin") + 1) * capacity)
    line = line.withColumns({"lo": lo, "hi": hi})
    line = line.select(
        "doc_id", (F.col("start") + F.col("lo") - F.col("at")).alias("start"), (F.col("hi") - F.col("lo")).alias("length"),
        F.expr("substring(ids, int(4 * (lo - at) + 1), int(4 * (hi - lo)))").alias("ids"), "doc_tokens",
        (F.lit(_REST) + F.col("bin")).alias("sequence_id"), (F.col("lo") - F.col("bin") * capacity).alias("offset"),
    )
    return binned.select(*line.columns).union(line)


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns; the ids of a piece become their CRC-32. An empty table gives no rows."""
    out = packed_pieces(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
