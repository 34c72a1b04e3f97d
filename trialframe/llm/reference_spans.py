"""Remove word spans that a reference corpus holds, with suffix automata.

The reference is cut into shards of at most SHARD_WORDS words (a longer
document is cut with an overlap of span - 1 words, so no span is missed). Each
shard's word hashes, 8 bytes a word and so at most 8 * SHARD_WORDS bytes, are
broadcast; a worker builds the shard's suffix automaton once, and every
document is streamed through it: the matching statistic of a word is the length
of the longest run ending there that the shard holds. Maximal spans of at least
``span`` words are removed.

Work grows with documents times shards, so this is for references of bounded
size (a benchmark, a list of boilerplate); a corpus against itself is what
trialframe.llm.substring_dedup does.

Edge cases: null and empty texts have no words; null and empty reference rows
match nothing; an empty reference removes nothing; an empty table returns no
rows; repeated rows are each returned.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialframe.llm.kernels import Words, slices
from trialframe.llm.substring_dedup import strip

SHARD_WORDS = 200_000
_BREAK = None  # between reference documents: no word equals it


class SuffixAutomaton:
    """All substrings of a sequence of symbols, in at most two states each."""

    def __init__(self, symbols):
        self.link, self.length, self.next = [-1], [0], [{}]
        last = 0
        for c in symbols:
            if c is _BREAK:
                last = 0
                continue
            last = self._extend(last, c)

    def _extend(self, last: int, c) -> int:
        link, length, nxt = self.link, self.length, self.next
        if c in nxt[last]:  # after a break: the run may be there already
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = len(length)
        link.append(0)
        length.append(length[last] + 1)
        nxt.append({})
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c, q: int) -> int:
        link, length, nxt = self.link, self.length, self.next
        twin = len(length)
        link.append(link[q])
        length.append(length[p] + 1)
        nxt.append(dict(nxt[q]))
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = twin
            p = link[p]
        link[q] = twin
        return twin

    def matching(self, symbols) -> Iterator[int]:
        """Length of the longest known run that ends at each symbol."""
        link, length, nxt = self.link, self.length, self.next
        v = n = 0
        for c in symbols:
            while v and c not in nxt[v]:
                v = link[v]
                n = length[v]
            if c in nxt[v]:
                v = nxt[v][c]
                n += 1
            else:
                n = 0
            yield n


def reference_shards(reference: DataFrame, span: int, shard_words: int, text_col: str) -> Iterator[list[np.ndarray]]:
    """Lists of word-hash arrays of at most shard_words words together."""
    held, size = [], 0
    for row in reference.select(text_col).where(F.col(text_col).isNotNull()).toLocalIterator():
        for _, _, data, offsets in slices(pa.array([row[0]])):
            h = Words(data, offsets).hashes()
            for at in range(0, max(1, len(h) - span + 1), shard_words - span + 1):
                part = h[at : at + shard_words]
                if len(part) < span:
                    continue
                if size + len(part) > shard_words:
                    yield held
                    held, size = [], 0
                held.append(part)
                size += len(part)
    if held:
        yield held


_built: dict = {}


def _automaton(key, shard: list[np.ndarray]) -> SuffixAutomaton:
    if _built.get("key") != key:  # one at a time in a worker
        _built.update(key=key, automaton=SuffixAutomaton(c for part in shard for c in [*part.tolist(), _BREAK]))
    return _built["automaton"]


def known_spans(shared, key: str, span: int):
    """Arrow function: starts s and ends e (in window starts) of known spans.
    shared: the broadcast shard; key: tells shards apart in a worker."""

    def run(texts: pa.Array) -> pa.Array:
        automaton = _automaton(key, shared.value)
        out = []
        for i, j, data, offsets in slices(texts):
            w = Words(data, offsets)
            h = w.hashes().tolist()
            for k in range(j - i):
                n = np.fromiter(automaton.matching(h[w.doc[k] : w.doc[k + 1]]), dtype=np.int64)
                hit = np.r_[False, n >= span, False]
                edge = np.flatnonzero(hit[1:] != hit[:-1])
                out.append([{"s": int(a) - span + 1, "e": int(b) - span + 1} for a, b in zip(edge[::2], edge[1::2])])
        return pa.array(out, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))

    return run


def remove_known(
    docs: DataFrame, reference: DataFrame, span: int = 20, shard_words: int = SHARD_WORDS,
    id_col: str = "doc_id", text_col: str = "text", reference_col: str = "text",
) -> DataFrame:
    """docs -> (id, n_words, n_removed, kept_text, kept_sha256), a row for each."""
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"))
    found, call = [], uuid.uuid4().hex
    for k, shard in enumerate(reference_shards(reference, span, shard_words, reference_col)):
        shared = spark.sparkContext.broadcast(shard)
        d = d.withColumn(f"_s{k}", F.arrow_udf(known_spans(shared, f"{call}-{k}", span), "array<struct<s:int,e:int>>")("_text"))
        found.append(f"_s{k}")
    runs = F.concat(*found) if found else F.lit(None).cast("array<struct<s:int,e:int>>")
    return strip(d.select("doc_id", "_text", runs.alias("runs")), span).withColumnRenamed("doc_id", id_col)
