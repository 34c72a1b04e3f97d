"""Operators against brute force, round trips and held-out accuracy."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tools.oracle_check import digest
from trialframe.llm import components, decontaminate, minmax_dedup, mixing, packing, pii, queries, rules_llr, substring_dedup, toxicity
from trialframe.llm.boosting import Boosted
from trialframe.llm.kernels import Words, gram_hashes, slices

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF_MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{SF_SMALL}/documents.parquet'").fetchall())


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF_SMALL)
    want = con.execute(queries.ORACLE[name])
    cols = [c[0] for c in want.description]
    assert sorted(cols) == sorted(got.columns)
    assert digest(got.columns, [tuple(r) for r in got.collect()])[0] == digest(cols, want.fetchall())[0]


def test_word_kernel_equals_pattern(texts):
    some = [*texts.values(), "", "a", " a  b\x0bc\x1cd\u00a0e ", "é\tü"]
    found = []
    for i, j, data, offsets in slices(pa.array([*some, None])):
        w, raw = Words(data, offsets), data.tobytes()
        h = w.hashes()
        grams = gram_hashes(h, 2)
        for k in range(j - i):
            words = [raw[w.starts[x] : w.ends[x]].decode() for x in range(w.doc[k], w.doc[k + 1])]
            found.append(words)
            for x, word in enumerate(words[:3]):
                assert h[w.doc[k] + x] == Words(np.frombuffer(word.encode(), np.uint8), np.array([0, len(word.encode())])).hashes()[0]
        assert len(grams) == len(h) - 1
    assert found == [WORD.findall(t) for t in some] + [[]]


# toxicity -----------------------------------------------------------------


def test_decode_restores_words(spark):
    words = ["idiot", "moron", "loser", "scum", "stupid", "clown", "garden", "window", "letter", "morning", "silent", "water"]
    lm = toxicity.language_model(spark.createDataFrame([(" ".join(words * 20),)], "text string"))
    for bad, good in [("1d10t", "idiot"), ("m0r0n", "moron"), ("l0$er", "loser"), ("i.d.i.o.t", "idiot"), ("s t u p i d", "stupid"),
                      ("stuuuupid", "stupid"), ("cl0wwwn", "clown"), ("$cum", "scum")]:
        assert toxicity.decode(bad, lm) == good, bad


def test_language_model_counts_all_text(spark, texts):
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = dict(map(tuple, d.select("text").mapInArrow(toxicity._lm_counts, "gram int, n long").groupBy("gram").agg(F.sum("n")).collect()))
    want: Counter = Counter()
    for t in texts.values():
        c = toxicity._CLASS[toxicity.lower_latin(np.frombuffer(t.encode(), np.uint8))].tolist()
        want.update((a * 128 + b) * 128 + e for a, b, e in zip(c, c[1:], c[2:]))
    assert got == dict(want)


def test_obfuscated_toxic_documents_are_found(spark):
    rng = random.Random(1)
    plain = ["garden", "window", "letter", "morning", "silent", "water", "river", "mountain", "table", "orange"]
    rows = []
    for k in range(300):
        words = [rng.choice(plain) for _ in range(40)]
        if k % 3 == 0:
            words[rng.randrange(40)] = rng.choice(["idiot", "moron"])
        rows.append((k, " ".join(words)))
    hidden = ["what an 1d10t he is", "such a m0r0n again", "you i d i o t there", "iiidiot", "M.O.R.O.N"]
    rows += [(1000 + k, t) for k, t in enumerate(hidden)] + [(2000, "call 555 1234 at 10:30 in room b4"), (2001, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(300)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, labels).collect()}
    assert all(got[1000 + k] >= 0.7 for k in range(len(hidden)))
    assert got[2000] < 0.1 and got[2001] < 0.1
    assert all((got[k] >= 0.7) == (k % 3 == 0) for k in range(300))


def _rank_quality(rows):
    pos = [r["score"] for r in rows if r["y"] == 1]
    neg = [r["score"] for r in rows if r["y"] == 0]
    return np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])


def test_quality_on_held_out_labels(spark):
    got = queries.op5_pu_quality(spark, SF_MEDIUM).join(
        spark.read.parquet(f"{SF_MEDIUM}/labels.parquet").select("doc_id", F.col("quality").alias("y")), "doc_id").where("held_out").collect()
    assert _rank_quality(got) > 0.99
    assert np.mean([r["predicted"] == r["y"] for r in got]) > 0.97


def test_toxicity_on_held_out_labels(spark):
    got = queries.op1_deobfuscated_toxicity(spark, SF_MEDIUM).join(
        spark.read.parquet(f"{SF_MEDIUM}/labels.parquet").select("doc_id", F.col("toxic").alias("y")), "doc_id").where("held_out").collect()
    assert not any(r["predicted"] for r in got if r["y"] == 0)
    assert np.mean([r["predicted"] for r in got if r["y"] == 1]) >= 0.5


def test_labels_of_held_out_documents_are_not_used(spark):
    """Flipping the held-out labels changes no score."""
    from trialframe.llm.helpers import held_out
    from trialframe.llm import pu_quality

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    out = []
    for flip in (False, True):
        y = F.when(held_out(F.col("doc_id")) & F.lit(flip), 1 - F.col("quality")).otherwise(F.col("quality"))
        trusted = labels.withColumn("quality", y).where(~held_out(F.col("doc_id")) & (F.col("quality") == 1)).select("doc_id")
        out.append(sorted(map(tuple, pu_quality.score(docs, trusted).select("doc_id", "score").collect())))
    assert out[0] == out[1]


# rules --------------------------------------------------------------------


def _spark_hash(*words: str) -> int:
    seed = 42
    for w in words:
        seed = xxhash.xxh64_intdigest(w.encode(), seed=seed)
    return seed


def test_rules_against_brute_force(spark, texts):
    bits, trusted = 10, [k for k in texts if k % 7 == 0]
    got = {r["doc_id"]: r for r in rules_llr.judge(
        spark.read.parquet(f"{SF_SMALL}/documents.parquet"), spark.createDataFrame([(k,) for k in trusted], "i long"), bits=bits).collect()}
    grams = {}
    for k, t in texts.items():
        w = WORD.findall(t)
        grams[k] = [_spark_hash(x) % 1024 for x in w] + [_spark_hash(x, y) % 1024 for x, y in zip(w, w[1:])]
    raw, good = Counter(g for v in grams.values() for g in v), Counter(g for k in trusted for g in grams[k])
    ratio = [np.log((good[b] + 1) / (good.total() + 1024)) - np.log((raw[b] + 1) / (raw.total() + 1024)) for b in range(1024)]
    assert got.keys() == texts.keys()
    for k, t in texts.items():
        w = WORD.findall(t)
        tri = list(zip(w, w[1:], w[2:]))
        often = Counter(tri)
        covered = {p + o for p, g in enumerate(tri) if often[g] > 1 for o in range(3)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered))
        r = got[k]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        assert r["base_failed"] == failed
        if w:
            assert abs(r["llr"] - np.mean([ratio[g] for g in grams[k]])) < 1e-5
        assert r["kept"] == (not failed and r["llr"] >= -0.075)


@pytest.mark.parametrize("most", [1_000_000, 10])
def test_every_trusted_document_counts(spark, monkeypatch, most):
    """With all documents trusted, both multinomials are the same."""
    monkeypatch.setattr(rules_llr, "MAX_BROADCAST_IDS", most)
    docs = spark.range(20_500).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("some"), F.col("id") % 977, F.col("id") % 31).alias("text"))
    got = rules_llr.log_ratios(docs, docs.select("doc_id"), 6, 1.0, "doc_id", "text").first()["weights"]
    assert got == [0.0] * 64
    one = docs.union(spark.createDataFrame([(None, "some more")], "doc_id long, text string"))
    again = rules_llr.with_trusted(one, docs.select("doc_id").where("doc_id < 20400"), "doc_id", "text")
    assert again.count() == 20_501 and again.where("_trusted = 1").count() == 20_400


# near duplicates ----------------------------------------------------------


def _brute_components(sets, percent):
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[:k]:
            met = len(sets[a] & sets[b])
            if met and 100 * met >= percent * (len(sets[a]) + len(sets[b]) - met):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_large_cluster_is_cut_into_blocks_without_losing_links(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(160):
        words = list(base)
        for _ in range(rng.randrange(0, 9)):
            words[rng.randrange(120)] = f"x{rng.randrange(10**9)}"
        rows.append((k, " ".join(words)))
    sets = {k: {tuple(t.split()[i : i + 3]) for i in range(118)} for k, t in rows}
    monkeypatch.setattr(minmax_dedup, "BLOCK", 30)
    got = minmax_dedup.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == _brute_components(sets, 85)


def test_components(spark):
    rng = random.Random(5)
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(200, 260)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(80)]
    edges += [(7, 7), (None, 3)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    sets = {}
    for a, b in edges:
        if a is not None and a != b:
            sets.setdefault(a, {a}).add(b)
            sets.setdefault(b, {b}).add(a)
    for _ in range(60):
        sets = {k: set().union(*(sets[x] for x in v)) for k, v in sets.items()}
    assert got == {k: min(v) for k, v in sets.items()}


def test_min_max_signature_is_unbiased():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 400, dtype=np.uint64)
    b = np.concatenate([a[:300], rng.integers(0, 2**63, 100, dtype=np.uint64)])
    mult = minmax_dedup._multipliers(500)
    same = (minmax_dedup.signature(np.sort(a), mult) == minmax_dedup.signature(np.sort(b), mult)).mean()
    assert abs(same - 300 / 500) < 0.05


# decontamination ----------------------------------------------------------


def test_reparameterised_questions(spark):
    item = "if a train with Anna leaves at 40 km per hour and a bus with Bernd leaves at 55 km per hour then when will Anna see the bus"
    docs = [
        (1, "Text first. " + item + " and so on"),
        (2, item.replace("40", "77").replace("55", "99").replace("Anna", "Clara").replace("Bernd", "Doro")),
        (3, item.replace("will Anna", "will Bernd")),  # the same slot stands for two names
        (4, "nothing of the kind is in here, only words that were put in some order for a test of it"),
        (5, item[: len(item) // 3]),
    ]
    bench = spark.createDataFrame([(9, item), (10, "too short")], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.find(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert [got[k]["contaminated"] for k in (1, 2, 3, 4, 5)] == [True, True, False, False, False]
    assert got[2]["items"] == [9]


def test_names_at_sentence_starts_and_of_several_words(spark):
    item = "Alice has 12 apples. Bob gives her 7 more apples. How many apples does Alice have now?"
    trip = "every summer the old painter from New York City walks slowly along the river to the market and buys fresh bread for the children in New York City"
    docs = [
        (1, item.replace("Alice", "Tom").replace("Bob", "Mary").replace("12", "31").replace("7", "5")),
        (2, "First. " + item.replace("Alice", "Jean Paul").replace("Bob", "Eve Adams")),
        (3, trip.replace("New York City", "Paris")),
        (4, "Tom has 12 pears. Mary eats them all. How many pears does Tom have now?"),
    ]
    bench = spark.createDataFrame([(1, item), (2, trip)], "item_id long, text string")
    got = {r["doc_id"]: r["items"] for r in decontaminate.find(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got == {1: [1], 2: [1], 3: [2], 4: []}


def test_exact_copies_of_items_without_windows(spark):
    items = [(1, "Compute 12 + 34 * 56 - 78 / 9 + 10"), (2, "What is 7 times 8?"), (3, "Add 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 up"), (4, "")]
    docs = [(k, f"some text, {t} and more") for k, t in items]
    docs += [(11, "some text, Compute 12 + 34 * 56 - 78 / 9 + 11 and more"), (12, "What is 7 times 9?"), (13, items[2][1].replace("8 9", "9 8")),
             (14, items[2][1][:30] + " and " + items[2][1][20:])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r["items"] for r in decontaminate.find(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got == {1: [1], 2: [2], 3: [3], 4: [], 11: [], 12: [], 13: [], 14: []}


def test_one_edited_slot_does_not_clear_a_long_copy(spark):
    words = [f"word{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(60)]
    words[15] = words[45] = "12"
    item = " ".join(words)
    edited = lambda k, x: " ".join([*words[:k], x, *words[k + 1 :]])
    docs = [(1, item), (2, edited(45, "twelve")), (3, edited(45, "13")), (4, edited(15, "13")), (5, " ".join(words[:10]))]
    bench = spark.createDataFrame([(9, item)], "item_id long, text string")
    got = {r["doc_id"]: r["n_windows"] for r in decontaminate.find(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    # 53 windows, 8 of them over each place; 5 has 3, too few
    assert got == {1: 53, 2: 45, 3: 45, 4: 45, 5: 0}


# mixing -------------------------------------------------------------------


def test_poisson_counts(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"))
    got = mixing.replicate(docs, shares={"a": 0.75, "b": 0.25}, repeat=2.0)
    n = {r["source"]: r["n"] for r in got.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert abs(n["a"] - 9000) < 400 and abs(n["b"] - 3000) < 250
    copies = Counter(r["n"] for r in got.where("source = 'a'").groupBy("doc_id").agg(F.count("*").alias("n")).collect())
    copies[0] = 2000 - sum(copies.values())
    mean = sum(k * v for k, v in copies.items()) / 2000
    var = sum(v * (k - mean) ** 2 for k, v in copies.items()) / 2000
    assert abs(mean - 4.5) < 0.2 and abs(var - 4.5) < 0.6
    again = mixing.replicate(docs.repartition(7), shares={"a": 0.75, "b": 0.25}, repeat=2.0)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, again.select(*got.columns).collect()))
    big = mixing.replicate(docs.limit(50).withColumn("source", F.lit("x")), repeat=100.0).groupBy("doc_id").count().collect()
    assert abs(np.mean([r["count"] for r in big]) - 100) < 6


# personal data ------------------------------------------------------------


def test_pii_base_against_patterns(spark, texts):
    extra = {10**6: "a@b.c.d x@y 1.2.3.4.5 999.1.1.1 x 4111 1111 1111 1111 +1 (262) 555-3752 +12 é 4111111111111112", 10**6 + 1: "mail me (at) home"}
    docs = spark.createDataFrame([*texts.items(), *extra.items()], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.find(docs).collect()}
    for k, t in {**texts, **extra}.items():
        spans = []
        for kind in pii.KINDS:
            for m in pii.BASE[kind].finditer(t):
                d = re.sub(r"[^0-9]", "", m[0])
                luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
                ok = {"email": True, "ip": all(int(p) < 256 for p in m[0].split(".")) if kind == "ip" else 0,
                      "card": 16 <= len(d) <= 19 and luhn, "phone": 8 <= len(d) <= 15}[kind]
                if ok:
                    spans.append(f"{kind}:{m.start()}:{m.end()}")
        assert got[k]["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert set(spans) <= set(got[k]["spans"].split(",")) | {""}
        assert [got[k][f"n_{x}"] for x in pii.KINDS] == [sum(s.startswith(x) for s in spans) for x in pii.KINDS]
    assert got[10**6]["n_card"] == 1 and got[10**6]["n_ip"] == 1


def test_redaction(spark):
    df = spark.createDataFrame([("a x@y.zz b", "email:2:8"), (None, ""), ("é", "")], "t string, s string")
    assert [r[0] for r in df.select(pii.redacted(F.col("t"), F.col("s"))).collect()] == ["a [email] b", None, "é"]


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    held = np.arange(3000) % 3 == 0
    p = Boosted().fit(x, y, held).predict(x)
    assert ((p > 0.5) == y)[held].mean() > 0.95
    assert abs(p[held].mean() - y[held].mean()) < 0.03


# substring dedup ----------------------------------------------------------


def _brute_kept(texts, span):
    seen, out = set(), {}
    for k in sorted(texts):
        w = WORD.findall(texts[k])
        gone = set()
        for s in range(len(w) - span + 1):
            g = tuple(w[s : s + span])
            if g in seen:
                gone |= set(range(s, s + span))
            seen.add(g)
        out[k] = [x for p, x in enumerate(w) if p not in gone]
    return out


@pytest.mark.parametrize("flush", [50, 100_000])
def test_substring_dedup_against_brute_force(spark, monkeypatch, flush):
    rng = random.Random(2)
    shared = [" ".join(rng.choice("abcdefg") + str(rng.randrange(30)) for _ in range(rng.randrange(15, 60))) for _ in range(6)]
    texts = {k: " ".join(x for _ in range(5) for x in (" ".join(f"u{rng.randrange(60)}" for _ in range(rng.randrange(40))), rng.choice(shared))) for k in range(80)}
    texts[80], texts[81] = "z " * 300, texts[3]
    monkeypatch.setattr(substring_dedup, "FLUSH_ROWS", flush)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["kept_text"].split() for r in substring_dedup.remove(docs).collect()}
    assert got == _brute_kept(texts, 20)


# packing ------------------------------------------------------------------


def test_packing_round_trip(spark):
    enc = packing.load_encoding(packing.vocabulary_path())
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = packing.pack(docs, row_tokens=700, shard_bytes=50_000).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["text"]}
    assert packing.decode(rows, enc) == texts
    for r in rows:
        cu = r["cu_seqlens"]
        assert cu[0] == 0 and cu[-1] == r["n_tokens"] <= 700 and r["position_resets"] == cu[:-1]
        assert set(np.frombuffer(r["input_ids"], "<u2")[cu[-1] :].tolist()) <= {packing.END_OF_TEXT}
    assert len({r["shard"] for r in rows}) > 3


def test_tokens_equal_whole_text_encoding(texts):
    enc = packing.load_encoding(packing.vocabulary_path())
    some = [*texts.values(), "", " a", "a ", "a  b \n c\u00a0 d\u2003 e 's don't 12 34", None, "x"]
    ids, bounds = packing.tokenize(pa.array(some), enc)
    for k, t in enumerate(some):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == enc.encode_ordinary(t or "")


def test_best_fit_against_naive():
    rng = np.random.default_rng(4)
    for capacity in (1, 7, 100):
        sizes = rng.integers(1, capacity + 1, 300)
        rooms: list[int] = []
        for s in sorted(sizes.tolist(), reverse=True):
            fit = [(room, k) for k, room in enumerate(rooms) if room >= s]
            if fit:
                rooms[min(fit)[1]] -= s
            else:
                rooms.append(capacity - s)
        rows = packing.best_fit_decreasing(sizes, capacity)
        assert sorted(k for r in rows for k in r) == list(range(300))
        assert sorted(capacity - int(sizes[r].sum()) for r in rows) == sorted(rooms)


# pipeline -----------------------------------------------------------------


def test_pipeline_against_its_parts(spark):
    """Stages judged on their own input; the packed text is that of the mixture."""
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    kept = [{r["doc_id"]: r["text"] for r in docs.collect()}]
    for _, stage in P.STAGES[:3]:
        docs = stage(spark, docs, SF_SMALL).checkpoint()
        kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
        assert kept[-1].items() <= kept[-2].items()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for k, t in kept[1].items():
        w = WORD.findall((t or "").translate(lower))
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    assert {k for k, c in _brute_components(sets, 80).items() if k == c} == kept[2].keys()
    bench = [t for (t,) in duckdb.sql(f"SELECT text FROM '{SF_SMALL}/benchmark.parquet'").fetchall()]
    assert not any(b in t for b in bench for t in kept[3].values())
    mixed = Counter(r["doc_id"] for r in P.STAGES[3][1](spark, docs, SF_SMALL).collect())
    assert mixed.keys() <= kept[3].keys()
    packed = Counter(d for r in P.run(spark, SF_SMALL).collect() for d, no in zip(r["doc_ids"], r["part_nos"]) if no == 0)
    assert packed == mixed
