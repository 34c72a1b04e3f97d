"""Toxicity of text after noisy-channel deobfuscation.

1. A character language model (byte trigrams of lower-cased words) is counted
   over every document.
2. Tokens that look obfuscated (digits or signs inside or at the end of words,
   a letter three times running, single letters or what imitates them spaced or
   dotted apart) become lattices: each character may stand for itself or for
   what it imitates, runs may collapse, separators may vanish, spaces may stay
   between words. Viterbi decoding under the language model picks the words.
   Tokens over PIECE characters are decoded piece by piece.
3. A lexicon is learned from labelled documents by sequential covering: of all
   restored words and word beginnings that are precise enough, take the one
   that explains most toxic documents not yet explained, until few are left;
   then add the words in at least BROAD_SHARE of the toxic documents.
   Beginnings carry over to inflections never seen in training.
4. A document's score is 1 - prod(1 - p) over the lexicon entries in its plain
   and restored words, p the smoothed precision of an entry.

The fit takes at most ``max_labelled`` labelled documents (smallest hashes of
their ids); the language model and the scores cover all documents whole.

Edge cases: null and empty texts get the base score; repeated rows get equal
scores and count each in the fit; null ids and null labels are not learned
from; without toxic labels every score is the base; an empty table returns no
rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialframe.llm.kernels import Words, lower_latin, mix64, slices

# fixed values: what characters of obfuscated words stand for
IMITATES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t",
}
SEPARATING = ".-_*'"
SUBSTITUTE, COLLAPSE, SKIP, KEEP_SIGN, KEEP_SPACE = -1.0, -0.3, -0.3, -6.0, -2.0
PIECE = 256
MAX_LABELLED = 10_000
BASE = 0.02
BROAD_LEAST, BROAD_SHARE = 8, 0.05
CLASSES = 128
_GRAM = "gram int, n long"


def _table(chars: str) -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[[ord(c) for c in chars]] = True
    return t


_LETTER = _table("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") | (np.arange(256) >= 0x80)
_LEET = _table("".join(IMITATES))
_SEP = _table(SEPARATING)
_STOP = _table(".,;:!?")
# byte classes of the language model: 0 no letter, a-z, then bytes of letters beyond ASCII
_CLASS = np.zeros(256, dtype=np.int64)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[0x80:0xC0] = np.arange(27, 91)
_CLASS[0xC0:] = 91 + np.arange(64) % 37


def _lm_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(CLASSES**3, dtype=np.int64)
    for batch in batches:
        for _, _, data, offsets in slices(batch.column(0)):
            c = _CLASS[lower_latin(data)]
            if len(c) < 3:
                continue
            inner = np.zeros(len(c) + 1, dtype=bool)
            inner[offsets] = True  # a trigram does not cross texts
            ok = ~(inner[1:-2] | inner[2:-1])
            total += np.bincount(((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:])[ok], minlength=len(total))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["gram", "n"])


def language_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """log P(class | two classes before), CLASSES**3 float32 values at most."""
    counts = docs.select(F.col(text_col).alias("text")).mapInArrow(_lm_counts, _GRAM).groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(CLASSES**3)
    n[counts["gram"].to_numpy()] = counts["n"].to_numpy()
    n = n.reshape(CLASSES, CLASSES, CLASSES)
    one = (n.sum((0, 1)) + 0.1) / (n.sum() + 0.1 * CLASSES)
    two = (n.sum(0) + 5 * one) / (n.sum((0, 2))[:, None] + 5)
    return np.log((n + 5 * two) / (n.sum(2)[:, :, None] + 5)).astype(np.float32)


def decode(token: str, lm: np.ndarray) -> str:
    """The likeliest plain words of an obfuscated token."""
    if len(token) > PIECE:
        return "".join(decode(token[k : k + PIECE], lm) for k in range(0, len(token), PIECE))
    text = token.lower()
    # state: last two classes -> (log probability, letters so far, last letter)
    states = {(0, 0): (0.0, "", "")}
    for i, ch in enumerate(text):
        letter = ch.isalpha()
        options = [(ch, 0.0)] if letter else [(x, SUBSTITUTE) for x in IMITATES.get(ch, "")]
        if not letter:
            options.append((ch, KEEP_SPACE if ch == " " else KEEP_SIGN))
        run = i > 0 and text[i - 1] == ch
        new: dict = {}
        for (a, b), (score, out, last) in states.items():
            moves = [((a, b), score + SKIP, out, last)] if ch in SEPARATING or ch == " " else []
            for x, cost in options:
                if run and x == last:
                    moves.append(((a, b), score + COLLAPSE, out, last))
                s, p, q = score + cost, a, b
                for byte in x.encode():
                    c = int(_CLASS[byte])
                    s, p, q = s + float(lm[p, q, c]), q, c
                moves.append(((p, q), s, out + x, x))
            for state, s, o, le in moves:
                if state not in new or s > new[state][0]:
                    new[state] = (s, o, le)
        states = new
    return max(((s + float(lm[a, b, 0]), o) for (a, b), (s, o, _) in states.items()))[1]


def suspects(w: Words) -> list[tuple[int, str]]:
    """(text, token) of the obfuscated-looking tokens of a slice."""
    data, n = w.data, len(w.data)
    if n < 3 or not len(w):
        return []
    letter, leet = _LETTER[data], _LEET[data]
    follows = np.r_[letter[1:], False]
    after = np.r_[False, letter[:-1]]
    odd = leet & (follows | (after & (data != ord("!"))))
    low = data | 0x20
    odd[1:-1] |= (low[1:-1] == low[:-2]) & (low[1:-1] == low[2:]) & letter[1:-1] & (data[1:-1] < 0x80)
    either = letter | leet
    dotted = _SEP[data] & np.r_[either[1:], False] & np.r_[False, either[:-1]]
    count = lambda flags: np.add.reduceat(np.r_[flags, False].astype(np.int64), np.column_stack([w.starts, w.ends]).ravel())[::2]
    letters, odds, dots, leets = count(letter & (data < 0x80)), count(odd), count(dotted), count(leet)
    found = np.flatnonzero((odds > 0) & ((letters >= 2) | (letters == 1) & (leets >= 2)) | (dots >= 2) & (dots >= letters - 1) & (letters >= 2))
    doc = np.searchsorted(w.doc, found, side="right") - 1
    raw = data.tobytes()
    out = [(int(d), raw[w.starts[k] : w.ends[k]].decode("utf-8", "replace")) for d, k in zip(doc, found)]
    # single ASCII letters, or what imitates them, spaced apart: three or more in one text, two letters
    # among them; the last may carry a mark of punctuation
    size = w.ends - w.starts
    plain = letter[w.starts] & (data[w.starts] < 0x80)
    one = plain | leet[w.starts]
    single = (size == 1) & one
    last = (size == 2) & one & _STOP[data[np.minimum(w.starts + 1, n - 1)]]
    owner = w.doc_of_word()
    seen = np.r_[0, np.cumsum(plain & (single | last))]
    edge = np.flatnonzero(np.diff(np.r_[0, np.where(single, owner + 1, 0)]))
    edge = np.r_[edge, len(single)]
    for a, b in zip(edge[:-1], edge[1:]):
        if single[a]:
            b += int(b < len(single) and last[b] and owner[b] == owner[a])
            if b - a >= 3 and seen[b] - seen[a] >= 2:
                out.append((int(owner[a]), raw[w.starts[a] : w.ends[b - 1]].decode("utf-8", "replace")))
    return out


_HEAD, _TAIL = re.compile(r"[^\w@$!|+]*"), re.compile(r"(?:[^\w@$|+]|_)*")


def bare_word(token: str) -> str:
    """Without the punctuation around it; signs that may be letters stay."""
    token = token[_HEAD.match(token).end() :]
    return token[: len(token) - _TAIL.match(token[::-1]).end()]


def _word_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of every word of letters: the word (an even hash), and
    its first 4 and 5 bytes (odd hashes)."""
    w = Words(lower_latin(data), offsets, _LETTER)
    size = w.ends - w.starts
    owner = w.doc_of_word()
    texts, feats = [owner], [w.hashes() & ~np.uint64(1)]
    for k in (4, 5):
        long = size > k
        part = Words.__new__(Words)
        part.data, part.starts, part.ends = w.data, w.starts[long], w.starts[long] + k
        texts.append(owner[long])
        feats.append(mix64(part.hashes() + np.uint64(k)) | np.uint64(1))
    return np.concatenate(texts), np.concatenate(feats)


def document_features(texts: pa.Array, lm: np.ndarray):
    """Per slice: first text, (text, feature) of plain and restored words, restored pairs."""
    known = lru_cache(maxsize=100_000)(lambda t: decode(t, lm))
    for i, j, data, offsets in slices(texts):
        owner, feats = _word_features(data, offsets)
        pairs = []
        for doc, token in suspects(Words(data, offsets)):
            bare = bare_word(token)
            plain = known(bare)
            if plain != bare.lower():
                pairs.append((doc, bare, plain))
        if pairs:
            more = [p.encode() for _, _, p in pairs]
            o2, f2 = _word_features(np.frombuffer(b"".join(more), dtype=np.uint8), np.r_[0, np.cumsum([len(m) for m in more])])
            owner, feats = np.r_[owner, np.array([p[0] for p in pairs])[o2]], np.r_[feats, f2]
        yield i, j, owner, feats, pairs


def learn_lexicon(
    doc: np.ndarray, feature: np.ndarray, word: np.ndarray, hits: np.ndarray, total: np.ndarray, least: int = 3
) -> tuple[np.ndarray, np.ndarray]:
    """Sequential covering. doc, feature: toxic documents by candidate feature;
    of each candidate: is it a word, and the toxic and all documents with it."""
    open_pair = np.ones(len(doc), dtype=bool)
    docs, doc = np.unique(doc, return_inverse=True)
    chosen: list[int] = []
    while True:
        gain = np.bincount(feature[open_pair], minlength=len(hits))
        if not len(gain) or gain.max() < least:
            break
        best = int(np.lexsort((-np.arange(len(hits)), hits, word, gain))[-1])
        chosen.append(best)
        covered = np.zeros(len(docs), dtype=bool)
        covered[doc[feature == best]] = True
        open_pair &= ~covered[doc]
    # words that covering left out since their documents hold others too
    broad = np.flatnonzero(word & (hits >= max(BROAD_LEAST, BROAD_SHARE * len(docs))))
    k = np.union1d(np.array(chosen, dtype=np.int64), broad)
    return k, (hits[k] + 0.1) / (total[k] + 1.0)


def train(docs: DataFrame, labels: DataFrame, lm: np.ndarray, max_labelled: int, id_col: str, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted lexicon features and log(1 - p) of each. labels: (id, toxic 0/1)."""
    ids = labels.select(F.col(labels.columns[0]).alias("_id"), F.col(labels.columns[1]).cast("int").alias("_y"))
    ids = ids.where("_id is not null and _y is not null").groupBy("_id").agg(F.max("_y").alias("_y"))
    ids = F.broadcast(ids.orderBy(F.xxhash64("_id"), "_id").limit(max_labelled))
    sample = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(ids, "_id")

    def distinct(texts: pa.Array) -> pa.Array:
        out = []
        for i, j, owner, feats, _ in document_features(texts, lm):
            order = np.lexsort((feats, owner))
            o, f = owner[order], feats[order]
            new = np.r_[True, (o[1:] != o[:-1]) | (f[1:] != f[:-1])] if len(o) else np.zeros(0, bool)
            o, f = o[new], f[new]
            at = np.searchsorted(o, np.arange(j - i + 1))
            out += [f[at[k] : at[k + 1]].view(np.int64) for k in range(j - i)]
        return pa.array(out, pa.list_(pa.int64()))

    held = sample.select("_id", "_y", F.explode(F.arrow_udf(distinct, "array<bigint>")("_text")).alias("f"))
    counts = held.groupBy("f").agg(F.sum("_y").alias("hits"), F.count(F.lit(1)).alias("total"))
    precise = counts.where("hits >= 4 and hits + 0.5 >= 0.9 * (total + 1)")
    pairs = held.where("_y = 1").select("_id", "f").join(precise, "f").toArrow()
    f, first, inverse = np.unique(pairs["f"].to_numpy(), return_index=True, return_inverse=True)
    k, p = learn_lexicon(pairs["_id"].to_numpy(), inverse, f % 2 == 0, pairs["hits"].to_numpy()[first], pairs["total"].to_numpy()[first])
    order = np.argsort(f[k].view(np.uint64))
    return f[k].view(np.uint64)[order], np.log1p(-p)[order]


def _rate(lm: np.ndarray, lexicon: np.ndarray, weight: np.ndarray):
    def run(texts: pa.Array) -> pa.Array:
        scores, restored = [], []
        for i, j, owner, feats, pairs in document_features(texts, lm):
            s = np.full(j - i, np.log1p(-BASE))
            if len(lexicon):
                at = np.minimum(np.searchsorted(lexicon, feats), len(lexicon) - 1)
                hit = lexicon[at] == feats
                both = np.unique(owner[hit] * len(lexicon) + at[hit])
                np.add.at(s, both // len(lexicon), weight[both % len(lexicon)])
            scores.append(np.round(-np.expm1(s), 6))
            by: list[list[str]] = [[] for _ in range(j - i)]
            for doc, token, plain in pairs:
                by[doc].append(f"{token}={plain}")
            restored += by
        return pa.StructArray.from_arrays(
            [pa.array(np.concatenate(scores) if scores else [], pa.float64()), pa.array(restored, pa.list_(pa.string()))], names=["score", "restored"]
        )

    return run


def score(
    docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """docs with columns score and restored (token=word of each decoded token)."""
    lm = language_model(docs, text_col)
    lexicon, weight = train(docs, labels, lm, max_labelled, id_col, text_col)
    rate = F.arrow_udf(_rate(lm, lexicon, weight), "struct<score:double,restored:array<string>>")
    return docs.withColumn("__rated", rate(F.col(text_col))).select(*docs.drop("score", "restored").columns, "__rated.score", "__rated.restored")
