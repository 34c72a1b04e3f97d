"""Token ids packed into fixed rows, best-fit decreasing.

Texts are tokenised with a public byte-level BPE; documents over ``row_tokens``
are split losslessly into full rows and a rest. The segments of a shard (at
most ``shard_tokens`` tokens of one input partition, so no shuffle is needed)
are taken longest first, each into the open row with the least room that holds
it. A segment tree over the room left, indexed by capacity, finds that row in
O(log row_tokens).

A row of the result is a row of the id matrix: ``input_ids`` little-endian
uint16 of row_tokens ids, padded with the end-of-text id; ``cu_seqlens``
cumulative segment lengths from 0 (padding excluded); ``position_resets`` where
positions start at 0 again (the starts of its segments); ``doc_ids`` and
``part_nos`` (from 0) of its segments. ``decode`` restores the texts.

Tokens are found once for each distinct piece of a shard: cutting before every
single space between two non-space characters never cuts a token.

Edge cases: null and empty texts have no tokens and are in no row; a document
with a null id is packed with doc id null; repeated rows are packed each; an
empty table returns no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialframe.llm.kernels import _power_table, mix64, text_buffers

DEFAULT_VOCABULARY = "byte_bpe_50k.tiktoken"
END_OF_TEXT = 50256
SHARD_BYTES = 16 << 20
PIECES = 100_000
_WIDTH: dict = {}
_SCHEMA = (
    "shard string, row_no int, input_ids binary, n_tokens int, cu_seqlens array<int>, position_resets array<int>,"
    " doc_ids array<long>, part_nos array<int>"
)


def vocabulary_path(name: str = DEFAULT_VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load_encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _piece_ids(raw: bytes, starts: np.ndarray, ends: np.ndarray, encoding) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the pieces, and how many each has. Pieces that begin with a space
    and end with another character are encoded many at a time: the bytes of
    the ids tell where each piece ends."""
    width = np.array([len(encoding.decode_single_token_bytes(t)) for t in range(encoding.n_vocab - 1)]) if _WIDTH.get("of") is not encoding else _WIDTH["width"]
    _WIDTH.update(of=encoding, width=width)
    data = np.frombuffer(raw, dtype=np.uint8)
    plain = (data[starts] == 32) & (data[ends - 1] > 32)
    ids: list[np.ndarray] = [np.zeros(0, dtype=np.uint16)]
    lengths = np.zeros(len(starts), dtype=np.int64)
    many, one = np.flatnonzero(plain), np.flatnonzero(~plain)
    for at in range(0, len(many), PIECES):
        group = many[at : at + PIECES]
        found = np.array(encoding.encode_ordinary(b"".join([raw[starts[k] : ends[k]] for k in group]).decode()), dtype=np.uint16)
        last = np.searchsorted(np.cumsum(width[found]), np.cumsum(ends[group] - starts[group])) + 1
        lengths[group] = np.diff(last, prepend=0)
        ids.append(found)
    for k in one:
        found = encoding.encode_ordinary(raw[starts[k] : ends[k]].decode())
        lengths[k] = len(found)
        ids.append(np.array(found, dtype=np.uint16))
    order = np.r_[many, one]  # the ids stand in this order
    begin = np.empty(len(starts), dtype=np.int64)
    begin[order] = np.cumsum(lengths[order]) - lengths[order]
    flat = np.concatenate(ids)
    source = np.arange(len(flat)) + np.repeat(begin - (np.cumsum(lengths) - lengths), lengths)
    return flat[source], lengths


def tokenize(texts: pa.Array, encoding) -> tuple[np.ndarray, np.ndarray]:
    """All ids (uint16) of the texts and the bounds of each text's."""
    data, offsets = text_buffers(texts)
    n = len(data)
    if not n:
        return np.zeros(0, dtype=np.uint16), np.zeros(len(offsets), dtype=np.int64)
    solid = (data > 32) | ((data < 9) | (data > 13)) & (data != 32)
    cut = np.zeros(n, dtype=bool)
    cut[1:-1] = (data[1:-1] == 32) & solid[:-2] & solid[2:]
    cut[offsets[:-1][offsets[:-1] < n]] = True
    starts = np.flatnonzero(cut)
    ends = np.r_[starts[1:], n]
    keys = np.empty(len(starts), dtype=np.uint64)
    step = 1 << 20  # pieces are hashed in runs of about this many bytes
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + step, side="right")))
        base, top = starts[at], ends[to - 1]
        pw, inv = _power_table(0x9E3779B97F4A7C15 | 1, int(top - base))
        total = np.zeros(top - base + 1, dtype=np.uint64)
        np.cumsum((data[base:top].astype(np.uint64) + np.uint64(1)) * pw[: top - base], out=total[1:])
        size = (ends[at:to] - starts[at:to]).astype(np.uint64)
        keys[at:to] = mix64((total[ends[at:to] - base] - total[starts[at:to] - base]) * inv[starts[at:to] - base] + size)
        at = to
    _, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
    flat, lengths = _piece_ids(data.tobytes(), starts[first], ends[first], encoding)
    begin = np.cumsum(lengths) - lengths
    size = lengths[inverse]
    out_end = np.cumsum(size)
    total = int(out_end[-1])
    source = np.arange(total) + np.repeat(begin[inverse] - (out_end - size), size)
    bounds = np.r_[0, out_end][np.searchsorted(starts, offsets)]
    return flat[source], bounds


class RoomTree:
    """Open rows by their room; the least room of at least a given size."""

    def __init__(self, most: int):
        self.width = 1 << (most + 1).bit_length()
        self.count = [0] * (2 * self.width)
        self.rows: dict[int, list[int]] = {}

    def add(self, room: int, row: int, by: int = 1) -> None:
        if by > 0:
            self.rows.setdefault(room, []).append(row)
        k = room + self.width
        while k:
            self.count[k] += by
            k >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return (room, row), or None."""
        k = size + self.width
        if not self.count[k]:
            while k > 1 and (k & 1 or not self.count[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.width:
                k *= 2
                if not self.count[k]:
                    k += 1
        room = k - self.width
        row = self.rows[room].pop()
        self.add(room, row, -1)
        return room, row


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Rows of segment indexes; sizes at most capacity, ties in given order."""
    tree = RoomTree(capacity)
    rows: list[list[int]] = []
    for k in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[k])
        found = tree.take(size)
        if found is None:
            room, row = capacity, len(rows)
            rows.append([])
        else:
            room, row = found
        rows[row].append(k)
        if room > size:
            tree.add(room - size, row)
    return rows


def _shard(name: str, ids: list, texts: pa.Array, encoding, capacity: int, pad: int) -> pa.RecordBatch:
    tokens, bounds = tokenize(texts, encoding)
    length = np.diff(bounds)
    parts = -(-length // capacity)
    owner = np.repeat(np.arange(len(length)), parts)
    part = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = bounds[owner] + part * capacity
    size = np.minimum(capacity, bounds[owner + 1] - begin)
    rows = best_fit_decreasing(size, capacity)
    matrix = np.full((len(rows), capacity), pad, dtype="<u2")
    cu = []
    for r, segments in enumerate(rows):
        ends = [0]
        for k in segments:
            to = ends[-1] + int(size[k])
            matrix[r, ends[-1] : to] = tokens[begin[k] : begin[k] + size[k]]
            ends.append(to)
        cu.append(ends)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([name] * len(rows), pa.string()), pa.array(np.arange(len(rows), dtype=np.int32)),
            pa.array([matrix[r].tobytes() for r in range(len(rows))], pa.binary()), pa.array([c[-1] for c in cu], pa.int32()),
            pa.array(cu, pa.list_(pa.int32())), pa.array([c[:-1] for c in cu], pa.list_(pa.int32())),
            pa.array([[ids[owner[k]] for k in s] for s in rows], pa.list_(pa.int64())),
            pa.array([[int(part[k]) for k in s] for s in rows], pa.list_(pa.int32())),
        ],
        names=["shard", "row_no", "input_ids", "n_tokens", "cu_seqlens", "position_resets", "doc_ids", "part_nos"],
    )


def _pack(vocabulary: str | None, capacity: int, shard_bytes: int, pad: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encoding, held, size, shard = None, [], 0, 0

        def flush():
            t = pa.Table.from_batches(held)
            texts = pa.concat_arrays([c.cast(pa.large_string()) for c in t.column(1).chunks])
            return _shard(f"{part:06d}-{shard:06d}", t.column(0).to_pylist(), texts, encoding, capacity, pad)

        for batch in batches:
            if encoding is None:
                encoding = load_encoding(vocabulary or vocabulary_path())
            at = 0
            sizes = np.diff(text_buffers(batch.column(1))[1])
            while at < batch.num_rows:
                room = np.searchsorted(np.cumsum(sizes[at:]), max(0, shard_bytes - size), side="right")
                to = min(batch.num_rows, at + max(int(room), 0 if size else 1))
                if to > at:
                    held.append(batch.slice(at, to - at))
                    size += int(sizes[at:to].sum())
                    at = to
                if at < batch.num_rows:
                    yield flush()
                    held, size, shard = [], 0, shard + 1
        if held:
            yield flush()

    return run


def pack(
    docs: DataFrame,
    row_tokens: int = 2048,
    vocabulary: str | None = None,
    pad_id: int = END_OF_TEXT,
    shard_bytes: int = SHARD_BYTES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """docs -> packed rows; vocabulary is the path of a tiktoken rank file."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return d.mapInArrow(_pack(vocabulary, row_tokens, shard_bytes, pad_id), _SCHEMA)


def decode(rows, encoding) -> dict:
    """Texts by doc id of collected rows, for round trips."""
    parts: dict = {}
    for r in rows:
        ids = np.frombuffer(r["input_ids"], dtype="<u2")
        for k, (doc, no) in enumerate(zip(r["doc_ids"], r["part_nos"])):
            parts.setdefault(doc, {})[no] = ids[r["cu_seqlens"][k] : r["cu_seqlens"][k + 1]].tolist()
    return {d: encoding.decode([t for no in sorted(p) for t in p[no]]) for d, p in parts.items()}
