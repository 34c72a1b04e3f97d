"""Remove word spans that occur earlier in the corpus.

A window is ``span`` consecutive words of one document; a word goes if a
window over it has the same words as a window that starts earlier (smaller id,
or same id and earlier start).

The method asked for, suffix automata of reference shards broadcast to all
tasks, is built in trialframe.llm.reference_spans for references of bounded
size. Here the reference is the corpus itself: its automata have no size bound
and every document would pass every shard (figures in the README). So windows
meet by shuffle instead:

1. Each window belongs to its minimizer, the smallest hash among its ``GRAM``-
   word grams. Equal windows have equal minimizers, and runs of about eight
   windows share one, so a run travels as one row: minimizer, document, start
   and ``BYTES`` bytes of each window's hash. Equal windows of a part
   (PART_BYTES of text) are settled there; only the earliest goes on, so a
   passage that is in a third of all documents costs one row for each part.
   Where a phrase is in very many documents with differing neighbours, one gram
   is the minimizer of all those windows. Minimizers with over ``heavy`` rows
   are found first, from the parts' own counts; a window of theirs travels alone
   and meets its equals under its full hash instead, so such a group is spread
   over all tasks.
2. Rows of a minimizer, or of a window, meet in a task, which finds the earliest place of each
   window and emits the runs of later ones.
3. Runs are joined with their document, whose uncovered words are kept.

Edge cases: null and empty texts have no words and keep nothing; texts under
``span`` words lose nothing; rows with the same id and start are the same
place, so neither is earlier; a document with a null id neither loses words nor
makes others lose any; an empty table returns no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialframe.llm.helpers import checkpointed
from trialframe.llm.kernels import Words, gram_hashes, mix64, slices, text_buffers

GRAM = 6
BYTES = 5
FLUSH_ROWS = 100_000
PART_BYTES = 8 << 20
# rows of a minimizer from which its windows travel alone; parts report counts under LOCAL by chance, as
# LOCAL; the threshold rises so that no more than MOST_HEAVY minimizers (8 bytes each) are broadcast
HEAVY_ROWS, LOCAL, MOST_HEAVY = 20_000, 32, 1_000_000
_RUN = "m long, doc_id long, start int, n int, windows binary"
_HIT = "doc_id long, s int, e int"


def windows(texts: pa.Array, span: int):
    """(text, start, minimizer, hash) of every window of the texts, in order."""
    out = []
    for i, j, data, offsets in slices(texts):
        w = Words(data, offsets)
        if len(w) < span:
            continue
        h = w.hashes()
        full = gram_hashes(h, span)
        doc = w.doc_of_word()[: len(full)]
        start = np.arange(len(full)) - w.doc[doc]
        inside = start + span <= np.diff(w.doc)[doc]
        grams = gram_hashes(h, GRAM)
        best = grams[: len(full)].copy()
        for k in range(1, span - GRAM + 1):
            np.minimum(best, grams[k : k + len(full)], out=best)
        out.append((doc[inside] + i, start[inside], best[inside], full[inside]))
    if not out:
        z = np.zeros(0, dtype=np.uint64)
        return z.astype(np.int64), z.astype(np.int64), z, z
    return tuple(np.concatenate(c) for c in zip(*out))


def later_places(key: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """True where a smaller (doc, start) has the same key."""
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    again = np.flatnonzero(count[inverse] > 1)
    late = np.zeros(len(key), dtype=bool)
    if len(again):
        order = again[np.lexsort((start[again], doc[again], inverse[again]))]
        g = inverse[order]
        first = np.r_[True, g[1:] != g[:-1]]
        head = order[np.maximum.accumulate(np.where(first, np.arange(len(g)), 0))]
        late[order] = (doc[order] != doc[head]) | (start[order] != start[head])
    return late


def _runs(*breaks: np.ndarray) -> np.ndarray:
    """Starts of the runs between breaks (boolean arrays), and the end."""
    b = breaks[0].copy()
    for x in breaks[1:]:
        b |= x
    return np.r_[np.flatnonzero(b), len(b)]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with an id, in parts of about PART_BYTES of text."""
    for batch in batches:
        known = batch.filter(batch.column(0).is_valid())
        offsets = text_buffers(known.column(1))[1]
        at = 0
        while at < known.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PART_BYTES, side="right")) - 1)
            yield known.slice(at, to - at)
            at = to


def _bounds(text: np.ndarray, late: np.ndarray, m: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """Starts of the rows that a part's windows travel in, and the end."""
    change = np.ones(len(text), dtype=bool)
    change[1:] = (text[1:] != text[:-1]) | (late[1:] != late[:-1]) | (~late[1:] & ((m[1:] != m[:-1]) | alone[1:]))
    return _runs(change)


def _count(span: int):
    """Rows of each minimizer in a part; n under LOCAL are reported as LOCAL with
    probability n / LOCAL (by hash), so that sums stay unbiased and few are
    sent. The null minimizer carries the sum. Any estimate gives the same
    result: it only decides which windows travel alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for known in _parts(batches):
            text, start, m, full = windows(known.column(1), span)
            if not len(text):
                continue
            ids = known.column(0).to_numpy()
            late = later_places(full, ids[text], start)
            first = _bounds(text, late, m, np.zeros(len(m), dtype=bool))[:-1]
            key, n = np.unique(m[first[~late[first]]], return_counts=True)
            coin = (mix64(key ^ mix64(ids[:1].astype(np.uint64))) % np.uint64(LOCAL)).astype(np.int64)
            n = np.where(n >= LOCAL, n, np.where(coin < n, LOCAL, 0))
            names = pa.array([*key[n > 0].view(np.int64).tolist(), None], pa.int64())
            yield pa.RecordBatch.from_arrays([names, pa.array([*n[n > 0].tolist(), int(n.sum())], pa.int64())], names=["m", "n"])

    return run


def heavy_minimizers(d: DataFrame, span: int, heavy: int) -> np.ndarray:
    """Sorted; MOST_HEAVY at most, as each has over 1/MOST_HEAVY of all rows."""
    counts = d.mapInArrow(_count(span), "m long, n long").groupBy("m").agg(F.sum("n").alias("n"))
    counts = checkpointed(counts.where(F.col("m").isNull() | (F.col("n") > heavy)))
    every = counts.where("m is null").select("n").first()
    least = max(heavy, every["n"] // MOST_HEAVY) if every else heavy
    got = counts.where(F.col("m").isNotNull() & (F.col("n") > least)).select("m").toArrow()
    return np.sort(got["m"].to_numpy().view(np.uint64))


def _emit(span: int, heavy: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for known in _parts(batches):
            ids = known.column(0).to_numpy()
            text, start, m, full = windows(known.column(1), span)
            if not len(text):
                continue
            doc = ids[text]
            late = later_places(full, doc, start)
            n = len(text)
            alone = np.zeros(n, dtype=bool)
            if len(heavy):
                alone = heavy[np.minimum(np.searchsorted(heavy, m), len(heavy) - 1)] == m
                m = np.where(alone, mix64(full), m)
            at = _bounds(text, late, m, alone)
            first, size = at[:-1], np.diff(at)
            gone = late[first]
            # a settled run carries no hashes and goes to a task of its own number
            byte = full.view(np.uint8).reshape(n, 8)[:, :BYTES]
            body = np.ascontiguousarray(byte[~late]).ravel()
            offsets = np.r_[0, np.cumsum(np.where(gone, 0, size * BYTES))].astype(np.int32)
            key = np.where(gone, mix64(first.astype(np.uint64) + doc[first].astype(np.uint64)), m[first])
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(doc[first]), pa.array(start[first].astype(np.int32)), pa.array(size.astype(np.int32)),
                 pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(body)])],
                names=["m", "doc_id", "start", "n", "windows"],
            )

    return run


def _settle(rows: pa.Table) -> pa.RecordBatch:
    """Runs of later windows among all the rows of some minimizers."""
    m, doc, start, n = (rows[c].to_numpy() for c in ("m", "doc_id", "start", "n"))
    body = rows["windows"].combine_chunks()
    if isinstance(body, pa.ChunkedArray):
        body = pa.concat_arrays(body.chunks)
    _, off, data = body.buffers()
    off = np.frombuffer(off, dtype=np.int32)[body.offset : body.offset + len(body) + 1]
    carried = np.diff(off) > 0
    hits = [(doc[~carried], start[~carried], n[~carried])]
    if carried.any():
        raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]].reshape(-1, BYTES)
        wide = np.zeros((len(raw), 8), dtype=np.uint8)
        wide[:, :BYTES] = raw
        row = np.repeat(np.flatnonzero(carried), n[carried])
        place = np.arange(len(row)) - np.repeat(np.cumsum(n[carried]) - n[carried], n[carried]) + start[row]
        key = mix64(wide.view(np.uint64).ravel() ^ mix64(m.view(np.uint64))[row])
        late = later_places(key, doc[row], place)
        new = np.ones(len(row), dtype=bool)
        new[1:] = (row[1:] != row[:-1]) | (late[1:] != late[:-1])
        at = _runs(new)
        keep = late[at[:-1]]
        first, size = at[:-1][keep], np.diff(at)[keep]
        hits.append((doc[row[first]], place[first], size))
    d, s, k = (np.concatenate(c) for c in zip(*hits))
    return pa.RecordBatch.from_arrays([pa.array(d), pa.array(s.astype(np.int32)), pa.array((s + k).astype(np.int32))], names=["doc_id", "s", "e"])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by minimizer; groups are settled whole."""
    held: list[pa.RecordBatch] = []
    rows, flush = 0, FLUSH_ROWS
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < flush:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        m = table["m"].to_numpy()
        cut = int(np.searchsorted(m, m[-1]))
        if cut:
            yield _settle(table.slice(0, cut))
        held, rows = table.slice(cut).to_batches(), rows - cut
        flush = max(FLUSH_ROWS, 2 * rows)
    if rows:
        yield _settle(pa.Table.from_batches(held))


def _strip(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, runs = batch.column(1), batch.column(2)
            n, gone, body = [], [], []
            for k in range(batch.num_rows):
                text = texts[k]
                words = text.as_buffer().to_pybytes().split() if text.is_valid else []
                n.append(len(words))
                if runs[k].is_valid and len(runs[k]):
                    part = runs[k].values
                    d = np.zeros(len(words) + 1, dtype=np.int64)
                    np.add.at(d, part.field("s").to_numpy(), 1)
                    np.add.at(d, np.minimum(part.field("e").to_numpy() + span - 1, len(words)), -1)
                    keep = np.cumsum(d[:-1]) == 0
                    words = [words[x] for x in np.flatnonzero(keep)]
                gone.append(n[-1] - len(words))
                body.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(body, pa.binary()).cast(pa.string()),
                 pa.array([hashlib.sha256(b).hexdigest() for b in body], pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"],
            )

    return run


def strip(found: DataFrame, span: int) -> DataFrame:
    """(doc_id, _text, runs) -> the words outside the runs of windows, which
    are structs of the first window start s and the end e of the starts."""
    schema = "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string"
    return found.select("doc_id", "_text", "runs").mapInArrow(_strip(span), schema)


def remove(
    docs: DataFrame, span: int = 20, id_col: str = "doc_id", text_col: str = "text", heavy: int = HEAVY_ROWS
) -> DataFrame:
    """docs -> (id, n_words, n_removed, kept_text, kept_sha256), a row for each."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"))
    runs = d.mapInArrow(_emit(span, heavy_minimizers(d, span, heavy)), _RUN)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = runs.repartition(parts, "m").sortWithinPartitions("m")
    hits = met.mapInArrow(_meet, _HIT).groupBy("doc_id").agg(F.collect_list(F.struct("s", "e")).alias("runs"))
    return strip(d.join(hits, "doc_id", "left"), span).withColumnRenamed("doc_id", id_col)
