"""Byte-level BPE as a lazily determinised transducer, and streaming decoding by a UTF-8 state machine.

A rank file is compiled to no table of merges: of every prefix of a piece exactly one token can stand last, namely the
one that the token before it can stand beside in some encoding. The transducer's state is what it has read since the
last token it emitted; a byte leads to the next state and to the tokens that every continuation agrees on. Such
transitions are computed when first met and kept (the determinised part of the machine), so emission lags the input
by a bounded number of bytes.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain

import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.common import small_batches, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Transitions and whole pieces kept by a worker; beyond, the store starts anew. It changes speed, never results.
KEPT_MOVES, KEPT_PIECES = 300_000, 400_000
#: Bytes that may be pending before the transducer looks which tokens are certain; it emits those and goes on.
LOOKAHEAD = 24
#: Bytes of a piece whose moves are made in one go.
AHEAD = 64
_NEVER = 1 << 60
_BYTES = [bytes((i,)) for i in range(256)]


class Transducer:
    """Encodes pieces (the matches of the splitting pattern, in UTF-8) one by one."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        #: the beginnings of tokens as a tree: from a node by a byte to the next; of each node the token's id (or None) and
        #: whether a longer token begins so
        self.next: dict[int, int] = {}
        self.ends: list[int | None] = [None]
        self.grows: list[bool] = [True]
        for t, rank in ranks.items():
            node = 0
            for byte in t:
                self.grows[node] = True
                to = self.next.get(node << 8 | byte)
                if to is None:
                    to = self.next[node << 8 | byte] = len(self.ends)
                    self.ends.append(None)
                    self.grows.append(False)
                node = to
            self.ends[node] = rank
        self.size = {i: len(t) for t, i in ranks.items()}
        self._spines: dict[int, tuple | None] = {}
        self._beside: dict[int, bool] = {}
        self._reset()

    def _reset(self) -> None:
        #: the next state, or with it the tokens that come out
        self._moves: dict[int, int | tuple[int, tuple[int, ...]]] = {}
        #: what states hold: token before, how many bytes are pending, last token at each place up to there (in a list that
        #: states behind this one may have written on), places where a token may start, each with the node it has come to
        self._body: list[tuple] = [(None, 0, [None], [(0, 0)])]
        #: states behind an emission, where different pasts meet
        self._met: dict[tuple, int] = {}

    def _spine(self, rank: int, token: bytes) -> tuple | None:
        """How a token grows: the pieces at its left edge and at its right edge over time, each with the rank of the
        merge that ends it; None for a token that the merges never build."""
        parts = [token[i : i + 1] for i in range(len(token))]
        left, right = [], []
        while len(parts) > 1:
            first, at = min((self.ranks.get(parts[i] + parts[i + 1], _NEVER), i) for i in range(len(parts) - 1))
            if first == _NEVER:
                break
            if at == 0:
                left.append((parts[0], first))
            if at == len(parts) - 2:
                right.append((parts[-1], first))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        whole = len(parts) == 1
        found = self._spines[rank] = (left + [(token, _NEVER)], right + [(token, _NEVER)]) if whole else None
        return found

    def beside(self, a: int, b: int) -> bool:
        """Whether no merge ever crosses the border between tokens a and b: at each moment the pieces that touch there
        must be merged away from each other before (on a tie the left one goes first) they would join."""
        right, left = self._spines[a][1], self._spines[b][0]
        i = j = 0
        ok = True
        while True:
            (x, ends_x), (y, ends_y) = right[i], left[j]
            joins = self.ranks.get(x + y, _NEVER)
            if joins < ends_x and joins <= ends_y and joins != _NEVER:
                ok = False
                break
            if ends_x == ends_y == _NEVER:
                break
            if ends_x <= ends_y:
                i += 1
            else:
                j += 1
        if len(self._beside) >= KEPT_MOVES:
            self._beside.clear()
        self._beside[a << 32 | b] = ok
        return ok

    def _path(self, last: list, end: int) -> list[int]:
        """The token borders from end back to the start of what is pending."""
        borders = [end]
        while borders[-1] > 0:
            borders.append(borders[-1] - self.size[last[borders[-1]]])
        return borders[::-1]

    def _certain(self, last: list, live: list) -> int:
        """The border up to which all continuations agree: what the paths to every place share at which a token that
        ends later may start."""
        sure = 0
        for borders in zip(*(self._path(last, s) for s in live), strict=False):
            if any(x != borders[0] for x in borders):
                break
            sure = borders[0]
        return sure

    def _read_on(self, state: int, piece: bytes, at: int, out: list[int]) -> tuple[int, int]:
        """Makes the moves of a piece from a state that has none for the byte at this place, up to the end, the next
        emission or AHEAD bytes: the state that is reached and the place behind it."""
        before, n, last, live = self._body[state]
        moves, bodies, step, ends, grows, spines, known = self._moves, self._body, self.next.get, self.ends, self.grows, self._spines, self._beside.get
        if len(last) > n + 1:  # written on from here before
            last = last[: n + 1]
        for at, byte in enumerate(piece[at : at + AHEAD], at + 1):
            found, still = None, []
            for s, node in live:
                node = step(node << 8 | byte)
                if node is None:
                    continue
                if grows[node]:
                    still.append((s, node))
                if found is None and (rank := ends[node]) is not None:
                    left = last[s] if s else before
                    fits = None if left is None else known(left << 32 | rank)
                    if fits is None:
                        spine = spines[rank] if rank in spines else self._spine(rank, piece[at - n - 1 + s : at])
                        fits = spine is not None and (left is None or self.beside(left, rank))
                    if fits:
                        found = rank
            if found is None:
                raise ValueError(f"no token for byte {byte}")
            n += 1
            still.append((n, 0))
            last.append(found)
            live = still
            key, state = state << 8 | byte, len(bodies)
            sure = self._certain(last, [s for s, _ in live]) if n > LOOKAHEAD else 0
            if sure:
                emitted = tuple(last[b] for b in self._path(last, sure)[1:])
                out.extend(emitted)
                before, n = emitted[-1], n - sure
                met = before, piece[at - n : at]
                state = self._met.setdefault(met, state)
                if state == len(bodies):
                    bodies.append((before, n, [None, *last[sure + 1 :]], [(s - sure, node) for s, node in live]))
                moves[key] = state, emitted
                break
            bodies.append((before, n, last, live))
            moves[key] = state
        return state, at

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        """Token ids of one piece; a piece that is a token whole is that token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        state, out, at, moves = 0, [], 0, self._moves.get
        while at < len(piece):
            for byte in memoryview(piece)[at:] if at else piece:
                move = moves(state << 8 | byte)
                if move is None:
                    break
                at += 1
                if type(move) is int:
                    state = move
                else:
                    state, emitted = move
                    out.extend(emitted)
            if at < len(piece):
                if len(self._moves) >= KEPT_MOVES:  # start anew from where we are
                    body = self._body[state]
                    self._reset()
                    moves, state = self._moves.get, 0
                    if body[1] or body[0] is not None:
                        self._body.append(body)
                        state = 1
                state, at = self._read_on(state, piece, at, out)
        _, at, last, _ = self._body[state]
        ids = []
        while at:
            ids.append(last[at])
            at -= self.size[last[at]]
        out.extend(reversed(ids))
        return tuple(out)


class _Pieces(dict):
    """Pieces met before; a miss runs the transducer."""

    def __init__(self, machine: Transducer):
        super().__init__()
        self.machine = machine

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= KEPT_PIECES:
            self.clear()
        ids = self.machine.encode_piece(piece.encode("utf-8", "surrogatepass"))
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class Utf8Stream:
    """An incremental UTF-8 decoder. The state is what an unfinished character has shown of itself; characters come
    out as soon as they are whole, malformed bytes as U+FFFD."""

    def __init__(self) -> None:
        self.pending = b""

    @staticmethod
    def _unfinished(data: bytes) -> int:
        """Bytes at the end that begin a character and need more."""
        for back in range(1, min(3, len(data)) + 1):
            b = data[-back]
            if b >= 0xC0:
                need = 2 if b < 0xE0 else 3 if b < 0xF0 else 4
                return back if back < need else 0
            if b < 0x80:
                return 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.pending + data
        cut = len(data) - self._unfinished(data)
        self.pending = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def end(self) -> str:
        rest, self.pending = self.pending, b""
        return rest.decode("utf-8", "replace")


class Codec:
    """Texts to ids and back, by a rank file's content and a splitting pattern."""

    def __init__(self, rank_file: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines()) if a}
        self.by_id = {i: t for t, i in self.ranks.items()}
        self.decimal = {i: str(i) for i in self.by_id}
        self.split = regex.compile(pattern).findall
        self.pieces = _Pieces(Transducer(self.ranks))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.split(text))))

    def forget(self) -> None:
        """Drop the stores; they are filled anew as pieces come."""
        self.pieces.clear()
        self.pieces.machine._reset()

    def decode_bytes(self, ids: list[int], step: int = 65536):
        """The bytes of ids, in pieces of so many tokens."""
        for at in range(0, len(ids), step):
            yield b"".join(map(self.by_id.__getitem__, ids[at : at + step]))

    def decode(self, ids: list[int]) -> str:
        stream = Utf8Stream()
        return "".join(map(stream.feed, self.decode_bytes(ids))) + stream.end()


_codecs: dict[tuple[str, str], Codec] = {}


def _codec(rank_file: bytes, pattern: str) -> Codec:
    """One codec for each worker process and vocabulary, with its determinised part."""
    key = hashlib.sha256(rank_file).hexdigest(), pattern
    if key not in _codecs:
        _codecs[key] = Codec(rank_file, pattern)
    return _codecs[key]


@contextmanager
def _uncollected():
    """The stores only grow and hold no cycles; walking them again and again for garbage would cost a third of the time."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def _shipped(spark: SparkSession, path: str | None):
    """The rank file, read once by the driver and broadcast: its size is that of the vocabulary."""
    with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(spark: SparkSession, text: Column, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> Column:
    """The ids (array<int>) of a text column; null encodes as the empty text."""
    small_batches(spark)
    file = _shipped(spark, path)

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = _codec(file.value, pattern)
        try:
            for texts in batches:
                with _uncollected():
                    out = pd.Series([codec.encode(t or "") for t in texts])
                yield out
        finally:  # workers that wait for other stages' tasks hold nothing but the vocabulary
            codec.forget()

    return ids(text)


def decode(spark: SparkSession, ids: Column, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> Column:
    """The text of an id column; null decodes as the empty text, bytes that are no UTF-8 as U+FFFD."""
    small_batches(spark)
    file = _shipped(spark, path)

    @F.pandas_udf("string")
    def texts(rows: pd.Series) -> pd.Series:
        codec = _codec(file.value, pattern)
        return pd.Series([codec.decode([] if r is None else list(r)) for r in rows], dtype=object)

    return texts(ids)


def round_trip_digests(spark: SparkSession, text: Column, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> Column:
    """Struct of n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the decoded text)."""
    small_batches(spark)
    file = _shipped(spark, path)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(texts: pd.Series) -> pd.DataFrame:
        codec = _codec(file.value, pattern)
        rows = []
        for t in texts:
            with _uncollected():
                ids = codec.encode(t or "")
            decoded, stream = hashlib.sha256(), Utf8Stream()
            for part in codec.decode_bytes(ids):
                decoded.update(stream.feed(part).encode("utf-8"))
            decoded.update(stream.end().encode("utf-8"))
            rows.append((len(ids), hashlib.sha256(",".join(map(codec.decimal.__getitem__, ids)).encode()).hexdigest(), decoded.hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return digests(text)


def encode_documents(docs: DataFrame, text: str = "text", path: str | None = None, name: str = "ids") -> DataFrame:
    """docs with an id array instead of the text. Null and empty texts give an empty array; very long texts take
    memory in proportion to one Arrow batch; repeated rows are encoded alike; other columns pass unread."""
    others = [c for c in docs.columns if c != text]
    return docs.select(*others, encode(docs.sparkSession, F.col(text), path).alias(name))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns of all documents: null texts are empty, repeated rows come each, no documents give no rows."""
    docs = table(spark, sf_dir, "documents")
    out = docs.select("doc_id", round_trip_digests(spark, F.col("text")).alias("d"))
    return out.select("doc_id", "d.n_tokens", "d.ids_sha256", "d.decoded_sha256")
