"""Vector bin packing of examples into training sequences.

An example has three sizes: tokens, segments (itself: one) and loss-bearing tokens. A sequence has
a limit on each. Whole multiples of the token limit are cut off first; what is left of an example
waits in a pool. The next piece of an open sequence is the waiting one whose size vector has the
largest dot product with the room that is left (both divided by the limits); where no piece fits
whole, the largest one is cut to the room. Every task packs its own input partition, so nothing is
shuffled; it holds the pool and one open sequence, whatever the size of the partition."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alleleflow.llm import encode
from alleleflow.llm.shared import in_slices, text_or_empty


@dataclass(frozen=True)
class Limits:
    tokens: int = 4096
    segments: int = 4096
    loss: int = 4096
    pool: int = 512       # waiting pieces among which the next one is chosen


@dataclass(slots=True)
class Piece:
    """Tokens start to start + length of example `key`; `loss` has a running count of its
    loss-bearing tokens, or is None if all of them are."""
    key: object
    start: int
    length: int
    ids: np.ndarray
    loss: np.ndarray | None
    total: int

    def n_loss(self) -> int:
        if self.loss is None:
            return self.length
        end = self.start + self.length
        return int(self.loss[end] - self.loss[self.start])

    def cut(self, n: int) -> Piece:
        """Take the first n tokens off."""
        head = Piece(self.key, self.start, n, self.ids, self.loss, self.total)
        self.start += n
        self.length -= n
        return head

    def fitting(self, tokens: int, loss: int) -> int:
        """How many of the first tokens keep within both limits."""
        n = min(tokens, self.length)
        if self.loss is None:
            return min(n, loss)
        run = self.loss[self.start + 1:self.start + n + 1] - self.loss[self.start]
        return int(np.searchsorted(run, loss, side="right"))


class Packer:
    """Feed pieces to `add`, which yields finished sequences (lists of pieces); `finish` yields
    the rest."""

    def __init__(self, limits: Limits):
        self.limits = limits
        self.caps = np.array([limits.tokens, limits.segments, limits.loss], dtype=np.float64)
        self.pieces: list[Piece | None] = [None] * limits.pool
        self.sizes = np.zeros((limits.pool, 3), dtype=np.int64)   # zero tokens: a free place
        self.free = list(range(limits.pool))
        self.open: list[Piece] = []
        self.room = self.caps.astype(np.int64)

    def _drop(self, k: int) -> Piece:
        piece, self.pieces[k], self.sizes[k] = self.pieces[k], None, 0
        self.free.append(k)
        return piece

    def _put(self, piece: Piece) -> None:
        self.open.append(piece)
        self.room = self.room - (piece.length, 1, piece.n_loss())

    def _close(self) -> list[Piece]:
        done, self.open, self.room = self.open, [], self.caps.astype(np.int64)
        return done

    def _step(self) -> list[Piece] | None:
        """Place one waiting piece; the sequence, if that finishes it."""
        waiting = self.sizes[:, 0] > 0
        score = (self.sizes / self.caps) @ (self.room / self.caps)
        whole = waiting & (self.sizes <= self.room).all(axis=1)
        if whole.any():
            self._put(self._drop(int(np.argmax(np.where(whole, score, -1.0)))))
        elif self.room[1] > 0:
            k = int(np.argmax(np.where(waiting, score, -1.0)))
            piece = self.pieces[k]
            n = piece.fitting(int(self.room[0]), int(self.room[2]))
            if n == 0:
                return self._close()
            self._put(piece.cut(n))
            if piece.length:
                self.sizes[k] = piece.length, 1, piece.n_loss()
            else:
                self._drop(k)
        else:
            return self._close()
        if self.room[0] == 0 or self.room[1] == 0:
            return self._close()
        return None

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        cap = self.limits.tokens
        while piece.length >= cap and piece.fitting(cap, self.limits.loss) == cap:
            yield [piece.cut(cap)]
        if not piece.length:
            return
        while not self.free:
            if done := self._step():
                yield done
        k = self.free.pop()
        self.pieces[k] = piece
        self.sizes[k] = piece.length, 1, piece.n_loss()

    def finish(self) -> Iterator[list[Piece]]:
        """Empty the pool. The last, unfilled sequence is cut at powers of two, which need no
        padding."""
        while self.sizes.any():
            if done := self._step():
                yield done
        rest, self.open = self.open, []
        left = sum(p.length for p in rest)
        while left:
            want = room = 1 << (left.bit_length() - 1)
            part = []
            while room:
                piece = rest[0]
                part.append(piece.cut(min(room, piece.length)))
                room -= part[-1].length
                if not piece.length:
                    rest.pop(0)
            left -= want
            yield part


_FIELDS = {"start": pa.int64(), "length": pa.int64(), "ids": pa.list_(pa.int32()), "ids_crc32": pa.int64(),
           "loss_tokens": pa.int64(), "doc_tokens": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64()}
PIECES = "start long, length long, ids array<int>, ids_crc32 long, loss_tokens long, doc_tokens long, sequence_id long, offset long"


def pack(examples: DataFrame, key: str, limits: Limits, tokens: Callable, columns: list[str], size_by: str,
         with_ids: bool = True) -> DataFrame:
    """Pack `examples` into sequences. `tokens` turns a record batch of `key` and `columns` into an
    iterator of (ids, loss mask or None) per row, in the worker; `size_by` names the string column
    whose bytes bound what is encoded at once. Returns a row per piece: the key, start, length,
    ids (null unless `with_ids`), ids_crc32, loss_tokens, doc_tokens, sequence_id, offset.

    Sequence ids are unique and depend on the input's partitions, which a stored table fixes.
    Examples without tokens give no piece. Keys may be null or repeat."""
    kind = examples.schema[key].dataType.simpleString()

    def run(batches):
        packer, state = Packer(limits), {"next": 0}
        rows: dict[str, list] = {c: [] for c in ("key", *_FIELDS)}
        held = 0

        def take(sequence):
            offset = 0
            for p in sequence:
                ids = p.ids[p.start:p.start + p.length]
                for c, v in zip(rows, (p.key, p.start, p.length, ids.astype(np.int32) if with_ids else None,
                                       zlib.crc32(ids.astype("<u4")), p.n_loss(), p.total,
                                       state["part"] << 40 | state["next"], offset)):
                    rows[c].append(v)
                offset += p.length
            state["next"] += 1

        def out():
            arrays = [pa.array(rows["key"], state["type"])] + [pa.array(rows[c], t) for c, t in _FIELDS.items()]
            for v in rows.values():
                v.clear()
            return pa.RecordBatch.from_arrays(arrays, names=[key, *_FIELDS])

        def each(batch):
            nonlocal held
            state["part"], state["type"] = batch.column("_part")[0].as_py(), batch.column(key).type
            for k, (ids, mask) in zip(batch.column(key).to_pylist(), tokens(batch)):
                loss = None if mask is None else np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
                for sequence in packer.add(Piece(k, 0, len(ids), ids, loss, len(ids))):
                    take(sequence)
            held += batch.num_rows
            if len(rows["key"]) >= 2000:
                yield out()

        yield from in_slices(each, size_by)(batches)
        for sequence in packer.finish():
            take(sequence)
        if rows["key"]:
            yield out()

    return (examples.select(key, *columns, F.spark_partition_id().alias("_part"))
            .mapInArrow(run, f"`{key}` {kind}, {PIECES}"))


def pack_documents(docs: DataFrame, limits: Limits = Limits(), end_id: int = 2, tokenizer: str | None = None,
                   with_ids: bool = True) -> DataFrame:
    """Pack whole texts (null: empty), each followed by `end_id`; all tokens bear loss. Extra
    columns are ignored."""
    tokenizer = tokenizer or encode.default_path()

    def tokens(batch):
        enc = encode.encoder(tokenizer)
        end = np.array([end_id], dtype=enc.dtype)
        for ids in enc.encode(batch.column("text").to_pylist()):
            yield np.concatenate([ids, end]), None

    return pack(docs.select("doc_id", text_or_empty()), "doc_id", limits, tokens, ["text"], "text", with_ids)


def pack_turns(turns: DataFrame, limits: Limits = Limits(segments=64, loss=3072), end_id: int = 2,
               tokenizer: str | None = None) -> DataFrame:
    """Pack instruction data: one row of `conv_id`, `role`, `text` per turn (null text: empty).
    Tokens of assistant turns bear loss, those of other or null roles do not."""
    tokenizer = tokenizer or encode.default_path()

    def tokens(batch):
        enc = encode.encoder(tokenizer)
        end = np.array([end_id], dtype=enc.dtype)
        for ids, role in zip(enc.encode(batch.column("text").to_pylist()), batch.column("role").to_pylist()):
            ids = np.concatenate([ids, end])
            yield ids, np.full(len(ids), role == "assistant")

    return pack(turns.select("conv_id", "role", text_or_empty()), "conv_id", limits, tokens, ["role", "text"], "text")
