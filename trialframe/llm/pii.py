"""Personal data by candidate generation and boosted trees.

The base rules (patterns plus checks) give spans that always stay. High-recall
generators propose wider, overlapping candidates of the same kinds; boosted
trees rate each by its format and context; candidates over the calibrated
threshold of their kind are added where they overlap no span already taken,
best first.

The trees learn what the base rules cannot say, from the base spans themselves.
Each span is rewritten with what the rule goes by hidden: @ and .
spelled out, the + or the country digits dropped, separators changed, a card
number written twice. A candidate on the rewritten place is positive; parts of
it, other kinds on it, and decoys (no dot in the domain, a part over 255, a
wrong check digit, the digits of a phone run together) are negative. Candidates
of the plain texts off the base spans are unlabelled: they count as negative in
a first fit, and those of them that rank with the upper half of the rewritten
positives of their kind are set aside from the second, which is kept. Per kind,
the threshold is the lowest calibrated probability from which at least
``precision`` of LEAST_HELD or more held-out candidates are positive, 0.5 at
least.

The trees and thresholds come from the candidates of all documents with an id:
equal examples are counted, and each level of a tree is one pass over them in
which only sums per node, feature and bin leave the tasks. Every third document
with candidates, by id, is held out for calibration and thresholds. All documents
are searched whole.

Edge cases: null and empty texts have no spans; repeated rows get equal spans;
null ids are searched and never fitted on; a kind without enough base spans
(LEAST_HELD held out) has nothing added; an empty table returns no
rows.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, StructField, StructType

from trialframe.llm.boosting import Block, Boosted, over
from trialframe.llm.helpers import checkpointed
from trialframe.llm.kernels import slices

KINDS = ("email", "ip", "card", "phone")
# fixed values: the base patterns of the contract
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
WIDE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]+(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]+)*"),
    "ip": re.compile(r"[0-9]{1,3}(?:[.,][0-9]{1,3}){3,5}"),
    "card": re.compile(r"[0-9](?:[ .-]?[0-9]){12,18}"),
    "phone": re.compile(r"(?:\+|\(|\b)[0-9][ ().0-9/-]{6,20}[0-9]"),
}
# a dotted number begins where its digits begin: the same matches, but a long run of digits is read once
_IP = re.compile(r"(?<![0-9])" + BASE["ip"].pattern)
# e-mail patterns from the @ on, and the characters before it
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_EMAIL_TAIL = re.compile(BASE["email"].pattern.partition("+@")[2].join(["@", ""]))
_WIDE_EMAIL_TAIL = re.compile(WIDE["email"].pattern.partition("+ ?")[2])
# fixed values: how @ and . of an address are written out
SPELLED = ((" (at) ", " (dot) "), ("(at)", "(dot)"), ("[at]", "[dot]"), (" [at] ", " [dot] "), (" (at) ", "."), ("(at)", "."), (" @ ", "."))
# numbers of their own inside longer matches, and the end of an address that runs on into a sentence
_ALONE = re.compile(r"(?<![0-9])[0-9]{13,19}(?![0-9])")
_SENTENCE = re.compile(r"\. ")
KEYWORDS = re.compile(r"mail|phone|call|tel|fax|card|visa|pay|ip|host|server|contact|@", re.I)
LEAST_HELD = 20
BLOCK_ROWS = 4096
PART_ROWS = 50_000
# probabilities are counted, for medians and thresholds, in steps of 1 / STEPS
STEPS = 1 << 16
CONTEXT = 40
# what a candidate to learn from is
NEGATIVE, POSITIVE, UNLABELLED = 0, 1, 2
_MARKED = np.zeros(256, dtype=bool)
_MARKED[[*range(0x30, 0x3A), ord("@")]] = True
_AT_WORD = re.compile(rb"\(at\)|\[at\]")


def _emails(text: str, tail: re.Pattern, spaced: bool) -> list[tuple[int, int]]:
    """The matches of ``[local]+`` (one space, if ``spaced``) ``tail``, found from
    the tail backwards: a search from the left would try every start in a long
    run of local characters, each to its end."""
    out, end, low = [], 0, 0
    for m in tail.finditer(text):
        stop = m.start() - (spaced and text[m.start() - 1 : m.start()] == " ")
        head = text[max(end, low) : stop]
        start = stop - (len(head) - len(head.rstrip(_LOCAL)))
        low = m.start()
        if start < stop:
            end = m.end()
            out.append((start, end))
    return out


def _byte(digits: str) -> bool:
    """At most 255, however many digits there are."""
    d = digits.lstrip("0")
    return len(d) <= 3 and int(d or 0) <= 255


def _passes(kind: str, found: str) -> bool:
    if kind == "ip":
        return all(_byte(p) for p in found.split("."))
    digits = [int(c) for c in found if c.isdigit()]
    if kind == "phone":
        return 8 <= len(digits) <= 15
    twice = [2 * d - 9 * (d > 4) for d in digits[-2::-2]]
    return 16 <= len(digits) <= 19 and (sum(digits[-1::-2]) + sum(twice)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start, in code points."""
    out = [(0, a, b) for a, b in _emails(text, _EMAIL_TAIL, False)] if "@" in text else []
    for k, kind in enumerate(KINDS[1:], 1):
        if kind == "phone" and "+" not in text:
            continue
        found = (_IP if kind == "ip" else BASE[kind]).finditer(text)
        out += [(k, m.start(), m.end()) for m in found if _passes(kind, m[0])]
    return out


def candidates(text: str) -> list[tuple[int, int, int]]:
    out = [(0, a, b) for a, b in _emails(text, _WIDE_EMAIL_TAIL, True)]
    return out + [(k, m.start(), m.end()) for k, kind in enumerate(KINDS[1:], 1) for m in WIDE[kind].finditer(text)]


def proposals(text: str) -> list[tuple[int, int, int]]:
    """The candidates and overlapping shorter ones inside them."""
    out = []
    for k, a, b in candidates(text):
        out.append((k, a, b))
        if k == 0 and (cut := _SENTENCE.search(text, a, b)):
            out.append((k, a, cut.start()))
    return sorted({*out, *((2, m.start(), m.end()) for m in _ALONE.finditer(text))})


def candidate_features(text: str, kind: int, start: int, end: int) -> list[float]:
    """Format and context of a candidate."""
    s = text[start:end]
    groups = re.findall(r"[0-9]+", s)
    sizes = [len(g) for g in groups] or [0]
    before, after = text[max(0, start - 24) : start], text[end : end + 24]
    kinds = [sum(c.isdigit() for c in s), sum(c.isalpha() for c in s), *(s.count(c) for c in ".- ()/,")]
    tail = s.rpartition(".")[2]
    digits = "".join(groups)
    luhn = len(digits) > 1 and (sum(map(int, digits[-1::-2])) + sum(2 * int(d) - 9 * (d > "4") for d in digits[-2::-2])) % 10 == 0
    return [
        float(luhn), float(all(_byte(g) for g in groups)), float("+" in s or before[-1:] == "+"),
        float(kind), float(len(s)), *map(float, kinds), float(len(groups)), float(sizes[0]), float(sizes[-1]), float(max(sizes)), float(min(sizes)),
        float(len(tail)), float(tail.isalpha()), float(s[:1] == "("), float(before[-1:].isspace() or not before), float(before[-1:].isalnum()),
        float(after[:1].isspace() or not after), float(after[:1].isalnum()), float(bool(KEYWORDS.search(before))), float(bool(KEYWORDS.search(after))),
        float(sum(c.isdigit() for c in before) / 24), float(sum(c.isdigit() for c in after) / 24),
    ]


WIDTH = len(candidate_features("", 0, 0, 0))


def _marked_texts(texts: pa.Array) -> Iterator[tuple[int, str]]:
    """(row, text) of those with a digit, an @ or a spelled-out @."""
    for i, _, data, offsets in slices(texts):
        c = np.r_[0, np.cumsum(_MARKED[data])]
        spelled = np.array([m.start() for m in _AT_WORD.finditer(data)], dtype=np.int64)
        has = (c[offsets[1:]] > c[offsets[:-1]]) | (np.searchsorted(spelled, offsets[1:]) > np.searchsorted(spelled, offsets[:-1]))
        for k in np.flatnonzero(has):
            yield i + int(k), data[offsets[k] : offsets[k + 1]].tobytes().decode()


def rewritten(kind: str, found: str, pick: int, decoy: bool) -> tuple[str, int] | None:
    """A base span in a form that its pattern misses, and the length of its
    first place in it; as a decoy, in such a form but without what makes it
    personal data."""
    groups = re.findall(r"[0-9]+", found)
    digits = "".join(groups)
    if kind == "email":
        at, dot = SPELLED[pick % len(SPELLED)]
        local, _, domain = found.rpartition("@")
        new = local + at + (domain.partition(".")[0] if decoy else domain.replace(".", dot))
    elif kind == "ip":
        if decoy:
            groups[pick % 4] = str(256 + pick % 744)
        new = ",".join(groups)
    elif kind == "card":
        if decoy:
            digits = digits[:-1] + str((int(digits[-1]) + 1 + pick % 9) % 10)
        if pick % 2:
            return f"{digits} {digits}", len(digits)
        new = ".".join(digits[k : k + 4] for k in range(0, len(digits), 4))
    elif decoy:
        new = digits
    elif len(groups) < 3:
        return None
    else:
        forms = [found[1:], "-".join(groups), ".".join(groups), " ".join(groups)]
        if len(digits) - len(groups[0]) >= 7:
            rest = groups[1:]
            forms += ["-".join(rest), ".".join(rest), f"({rest[0]}) {'-'.join(rest[1:])}"]
        new = forms[pick % len(forms)]
    return new, len(new)


def _free(spans: list, taken: list) -> list:
    """The spans that overlap none of the taken ones."""
    ends: list[tuple[int, int]] = []
    for a, b in sorted((a, b) for _, a, b in taken):
        if ends and a <= ends[-1][1]:
            ends[-1] = (ends[-1][0], max(b, ends[-1][1]))
        else:
            ends.append((a, b))
    firsts, lasts = np.array([a for a, _ in ends], dtype=np.int64), np.array([b for _, b in ends], dtype=np.int64)
    return [(k, a, b) for k, a, b in spans if np.searchsorted(firsts, b) == np.searchsorted(lasts, a, side="right")]


def examples(text: str) -> Iterator[tuple[int, int, list[float]]]:
    """(kind, what it is, features) of the candidates to learn from."""
    base = base_spans(text)
    for k, a, b in _free(proposals(text), base):
        yield k, UNLABELLED, candidate_features(text, k, a, b)
    for kind, start, end in base:
        found, before, after = text[start:end], text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
        pick = zlib.crc32(f"{start}:{found}".encode())
        for decoy in (False, True):
            new = rewritten(KINDS[kind], found, pick >> 1 if decoy else pick, decoy)
            if new is None:
                continue
            near, low = before + new[0] + after, len(before)
            high, whole = low + new[1], low + len(new[0])
            for k, a, b in _free(proposals(near), base_spans(near)):
                if b <= low or a >= whole:
                    continue
                hit = not decoy and k == kind
                if hit and ((a, b) == (low, high) or (whole > high and (a, b) == (whole - new[1], whole))):
                    yield k, POSITIVE, candidate_features(near, k, a, b)
                elif not (hit and a <= low and high <= b):
                    yield k, NEGATIVE, candidate_features(near, k, a, b)


def _gives_examples(texts: pa.Array) -> pa.Array:
    out = np.zeros(len(texts), dtype=bool)
    for row, text in _marked_texts(texts):
        out[row] = next(examples(text), None) is not None
    return pa.array(out)


def _learnt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to the examples of the texts: id, kind, what, features as bytes."""
    for batch in batches:
        out: list[tuple] = []

        def made() -> pa.RecordBatch:
            rows, *cols = ([r[k] for r in out] for k in range(4))
            ids = batch.column("_id").take(pa.array(rows, pa.int64()))
            return pa.RecordBatch.from_arrays([ids, *map(pa.array, cols, (pa.int32(), pa.int32(), pa.binary()))], ["_id", "kind", "what", "x"])

        for row, text in _marked_texts(batch.column("_text")):
            for k, what, features in examples(text):
                out.append((row, k, what, _packed([features])))
                if len(out) >= BLOCK_ROWS:
                    yield made()
                    out.clear()
        if out:
            yield made()


def _packed(features: list[list[float]]) -> bytes:
    return np.array(features, dtype="<f4").tobytes()


def _unpacked(x: pa.Array, width: int = WIDTH, kind: str = "<f4") -> np.ndarray:
    """The rows of a column of equally long bytes."""
    return np.frombuffer(b"".join(x.to_pylist()), dtype=kind).reshape(-1, width)


def _edges(rows: DataFrame, probs: np.ndarray) -> list[np.ndarray]:
    """The exact quantiles of each feature, interpolated. A feature is a count or
    a share of 24: to the driver go its distinct values, as many as there are
    lengths at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, n = _unpacked(batch.column("x")), np.asarray(batch.column("n"))
            for k in range(WIDTH):
                v, which = np.unique(x[:, k], return_inverse=True)
                each = np.bincount(which, weights=n, minlength=len(v)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), k)), pa.array(v.astype(float)), pa.array(each)], ["k", "v", "n"])

    counts = rows.select("x", "n").mapInArrow(count, "k long, v double, n long").groupBy("k", "v").agg(F.sum("n").alias("n")).toPandas()
    out = []
    for k in range(WIDTH):
        mine = counts[counts["k"] == k].sort_values("v")
        v, to = mine["v"].to_numpy(), mine["n"].to_numpy().cumsum()
        place = probs * (to[-1] - 1)
        low, high = (v[np.searchsorted(to, f(place), side="right")] for f in (np.floor, np.ceil))
        out.append(np.unique(low + (place - np.floor(place)) * (high - low)))
    return out


def _of_blocks(edges: list[np.ndarray], blocks: list[Block]) -> Boosted:
    return Boosted().fit_blocks(edges, lambda f: sum(map(f, blocks)))


def _fitted(rows: DataFrame) -> Boosted:
    """The trees over all examples: held, y, x, n."""
    model = Boosted()
    labels = rows.groupBy("held", "y").agg(F.sum("n").alias("n")).toPandas()
    held, y, n = (labels[c].to_numpy() for c in ("held", "y", "n"))
    if len(set(y.tolist())) < 2:
        return model.fit_blocks([], lambda f: f(Block(np.zeros((len(n), 0)), y, held.astype(bool), n)) if len(n) else 0)
    every = Boosted.fits_every(held.astype(bool), y, n)
    edges = model.edges = _edges(rows if every else rows.where("not held"), model.probs())

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cols = [np.asarray(batch.column(c).to_numpy(zero_copy_only=False), dtype=t).tobytes() for c, t in (("y", "f8"), ("held", "?"), ("n", "i8"))]
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(batch.column("b").to_pylist())]), *(pa.array([c]) for c in cols)], ["b", "y", "held", "n"])

    binned = F.arrow_udf(lambda x: pa.array([r.tobytes() for r in model.binned(_unpacked(x))], pa.binary()), "binary")
    equal = rows.select("held", "y", binned("x").alias("b"), "n").groupBy("held", "y", "b").agg(F.sum("n").alias("n"))
    parts = 1 + equal.count() // PART_ROWS
    blocks = equal.coalesce(parts).mapInArrow(block, "b binary, y binary, held binary, n binary").rdd.map(
        lambda r: Block(np.frombuffer(r["b"], "u1").reshape(-1, WIDTH), np.frombuffer(r["y"], "f8"), np.frombuffer(r["held"], "?"), np.frombuffer(r["n"], "i8"))
    ).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if parts == 1:  # up to PART_ROWS rows are fitted where they lie: the same sums, without a job for each
            return blocks.mapPartitions(lambda part: [_of_blocks(edges, list(part))]).first()
        return Boosted().fit_blocks(edges, over(blocks))
    finally:
        blocks.unpersist()


def _steps(rows: DataFrame, model: Boosted) -> DataFrame:
    """The rows with their probability in whole STEPS."""
    step = F.arrow_udf(lambda x: pa.array(np.floor(model.predict(_unpacked(x)) * STEPS).astype(np.int64)), "long")
    return rows.withColumn("p", step("x"))


def train(docs: DataFrame, precision: float, id_col: str, text_col: str) -> tuple[Boosted, list[float]]:
    """The trees, and the threshold of each kind (above 1: add nothing)."""
    d = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where("_id is not null")
    ids = d.where(F.arrow_udf(_gives_examples, "boolean")("_text")).select("_id").distinct().orderBy("_id")
    third = StructType([d.schema["_id"], StructField("held", BooleanType())])
    held = d.sparkSession.createDataFrame(ids.rdd.zipWithIndex().map(lambda r: (r[0]["_id"], r[1] % 3 == 0)), third)
    found = StructType([d.schema["_id"], *(StructField(c, IntegerType()) for c in ("kind", "what")), StructField("x", BinaryType())])
    rows = d.mapInArrow(_learnt, found).join(held, "_id").groupBy("held", "kind", "what", "x").agg(F.count(F.lit(1)).alias("n"))
    rows = checkpointed(rows).withColumn("y", (F.col("what") == POSITIVE).cast("double"))
    first = _steps(rows, _fitted(rows))
    sure = first.where(F.col("what") == POSITIVE).groupBy("kind", "p").agg(F.sum("n").alias("n")).toPandas()
    aside = F.lit(False)
    for kind, mine in sure.sort_values("p").groupby("kind"):
        to = mine["n"].to_numpy().cumsum()
        middle = mine["p"].to_numpy()[np.searchsorted(to, [(to[-1] - 1) // 2, to[-1] // 2], side="right")].mean()
        aside |= (F.col("kind") == int(kind)) & (F.col("what") == UNLABELLED) & (F.col("p") >= float(middle))
    rows = checkpointed(first.where(~aside).drop("p"))
    model = _fitted(rows)
    tail = _steps(rows.where("held"), model).groupBy("kind", "p").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("y")).alias("hits")).toPandas()
    limits = []
    for k in range(len(KINDS)):
        mine = tail[tail["kind"] == k].sort_values("p", ascending=False)
        n, hits = mine["n"].to_numpy().cumsum(), mine["hits"].to_numpy().cumsum()
        at = mine["p"].to_numpy()[(n >= LEAST_HELD) & (hits >= precision * n)]
        limits.append(max(0.5, float(at[-1]) / STEPS) if len(at) else 2.0)
    return model, limits


def all_spans(text: str, model: Boosted, limits: list[float]) -> tuple[list, list]:
    base = base_spans(text)
    taken = list(base)
    wide = _free(proposals(text), base) if min(limits) <= 1 else []
    if wide:
        covered = np.zeros(len(text), dtype=bool)
        p = model.predict(np.array([candidate_features(text, *c) for c in wide], dtype="<f4"))
        for q, (k, a, b) in sorted(zip(p.tolist(), wide), key=lambda x: (-x[0], x[1])):
            if q >= limits[k] and not covered[a:b].any():
                covered[a:b] = True
                taken.append((k, a, b))
    return base, sorted(taken)


def _written(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find(
    docs: DataFrame, precision: float = 0.98, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """docs with n_email, n_ip, n_card, n_phone (base spans), base_sha256 and
    spans (``kind:start:end``, comma-joined, base and added)."""
    model, limits = train(docs, precision, id_col, text_col)

    def search(texts: pa.Array) -> pa.Array:
        n = len(texts)
        counts = np.zeros((n, len(KINDS)), dtype=np.int64)
        digest, spans = [hashlib.sha256(b"").hexdigest()] * n, [""] * n
        for row, text in _marked_texts(texts):
            base, every = all_spans(text, model, limits)
            for k, _, _ in base:
                counts[row, k] += 1
            digest[row], spans[row] = hashlib.sha256(_written(base).encode()).hexdigest(), _written(every)
        cols = [pa.array(counts[:, k]) for k in range(len(KINDS))]
        return pa.StructArray.from_arrays([*cols, pa.array(digest), pa.array(spans)], names=[*(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    kind = "struct<" + ",".join(f"n_{k}:long" for k in KINDS) + ",base_sha256:string,spans:string>"
    own = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
    found = docs.withColumn("__pii", F.arrow_udf(search, kind)(F.col(text_col)))
    return found.select(*docs.drop(*own).columns, *(F.col(f"__pii.{c}").alias(c) for c in own))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets."""

    def run(texts: pa.Array, found: pa.Array) -> pa.Array:
        out = texts.to_pylist()
        for row, s in enumerate(found.to_pylist()):
            parts = [x.split(":") for x in s.split(",")] if s and out[row] is not None else []
            for kind, a, b in sorted(parts, key=lambda x: -int(x[1])):
                out[row] = out[row][: int(a)] + f"[{kind}]" + out[row][int(b) :]
        return pa.array(out, pa.string())

    return F.arrow_udf(run, "string")(text, spans)
