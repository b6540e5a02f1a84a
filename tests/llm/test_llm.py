"""Each operator against a brute-force version or known cases; nulls, empty and long texts, ties, repeats, empty tables, other columns."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievework.llm import langid, lattice, line_dedup, lm_scoring, mixing, packing, secrets, simhash, token_counts
from sievework.llm.components import connected_components
from sievework.llm.exact_dedup import exact_groups
from sievework.llm.queries import ORACLES, QUERIES
from sievework.llm.tiles import forest, link_in_tiles

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, run long, fp long, _text string, mix_block string, row string, score string, kept_text string, id string, _source string, _rank string, text_sha256 string, m map<string,int>"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def frame(spark, rows):
    """Documents with more columns, whose names clash with those that operators use."""
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), 1, 2, "x", "y", "z", None, "k", "i", "s", "r", "h", {"a": 1}) for i, t, lang, s in rows], SCHEMA)


def awkward():
    rng = random.Random(5)
    prose = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    long = "\n".join(" ".join(rng.choice(WORDS) for _ in range(12)) for _ in range(3000))
    shared = "This line is in many documents, word for word."
    rows = [(i, p + "\n" + shared if i % 4 == 0 else p, "en", f"s{i % 3}") for i, p in enumerate(prose)]
    rows += [(100, None, None, None), (101, "", "en", None), (102, " \t\r\n", None, "s0"), (103, long, "en", "s1"), (104, long + " ", "en", "s1"), (105, "ÄÖÜ ſ   K 日本 \U0001f600\n\n", "de", "s2")]
    rows += [(106, prose[0], "en", "s0")] * 2 + [(None, prose[1], None, "s1"), (None, "only here without a number", "en", "s2"), (0, prose[0] + "\n" + shared, "en", "s0")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, awkward()).repartition(5).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return frame(spark, [])


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    found = duck.sql(ORACLES[name])
    place = [found.columns.index(c) for c in df.columns]
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(str(tuple(r[i] for i in place)) for r in found.fetchall())


# 1 packing


def brute_best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(capacity - n)
    return len(rooms)


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 40).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=120))))
def test_plan_is_best_fit(case):
    capacity, lengths = case
    runs, bins = packing.best_fit_plan(Counter(lengths), capacity)
    held: dict = {}
    for n, _, number, first, at in runs:
        for i in range(number):
            held.setdefault(first + i, []).append((at, n))
    for pieces in held.values():
        pieces.sort()
        assert [a for a, _ in pieces] == list(itertools.accumulate([0] + [n for _, n in pieces]))[:-1]
        assert sum(n for _, n in pieces) <= capacity
    assert sorted(n for p in held.values() for _, n in p) == sorted(lengths)
    assert len(held) == bins == brute_best_fit(lengths, capacity)


def test_plan_of_large_counts():
    runs, bins = packing.best_fit_plan({n: 10**10 + n for n in range(1, 1025)})
    assert len(runs) < 50_000 and bins >= sum(n * (10**10 + n) for n in range(1, 1025)) / 1024


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=200))
def test_ids_are_the_tokenizers(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    if not hasattr(test_ids_are_the_tokenizers, "made"):
        test_ids_are_the_tokenizers.made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.byte_bpe(packing.default_ranks())
    slow, fast = test_ids_are_the_tokenizers.made
    for t in (text, text + "<|endoftext|>" + text, text * 3 + "　 \x85 "):
        assert packing.document_ids(fast, t).tolist() == slow.encode(t, add_special_tokens=False).ids + [2]


def test_packing(spark, docs, nothing):
    assert packing.pack_documents(nothing).count() == 0
    got = packing.pack_documents(docs, with_ids=True, capacity=256).collect()
    encoding = packing.byte_bpe(packing.default_ranks())
    sequences, whole = {}, {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        whole.setdefault(r.doc_id, []).append(r)
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length <= 256
        assert r.piece == 0 or r.length == 256
    for pieces in sequences.values():
        pieces.sort()
        assert [a for a, _ in pieces] == list(itertools.accumulate([0] + [n for _, n in pieces]))[:-1] and sum(n for _, n in pieces) <= 256
    for ident, text in {(r[0], r[1]) for r in awkward() if awkward().count(r) == 1 and r[0] not in (None, 0)}:
        ids = [i for r in sorted(whole[ident], key=lambda r: r.piece) for i in r.ids]
        assert ids == packing.document_ids(encoding, text).tolist()
    assert len(whole[106]) == 2 and len(whole[None]) == 2 and [r.ids for r in whole[100]] == [[2]]


# 2 language


def test_language(spark, nothing):
    rng = random.Random(1)
    kinds = {"en": "the of and ing tion er".split(), "de": "der ein ung sch über keit".split(), "fr": "le que eau ment ois é".split()}
    rows = [(i, " ".join("".join(rng.choice(kinds[lang]) for _ in range(3)) for _ in range(rng.randint(5, 80))), lang, "s") for i in range(600) for lang in [list(kinds)[i % 3]]]
    rows += [(1000, None, "en", "s"), (1001, "", None, "s"), (1002, "12 ²³ _!", "en", "s"), (1003, "sch" * 200_000, "de", "s"), (1004, "x", None, "s"), (None, "der ein ung", None, None)]
    df = frame(spark, rows)
    held = langid.remainder("doc_id", 4) == 2
    model = langid.fit_language_model(df.where(~held))
    got = langid.identify(df.withColumn("held", held), model).collect()
    assert len(got) == len(rows) and set(got[0].row.asDict()) == {*df.columns, "held"}
    tested = [r for r in got if r.row.held and r.row.doc_id < 600]
    assert sum(r.lang_pred == r.row.lang for r in tested) / len(tested) > 0.97
    assert not any(r.rejected for r in got if r.row.doc_id is not None and r.row.doc_id < 600 and len(r.row.text) > 100)
    by = {r.row.doc_id: r for r in got}
    assert all((by[i].lang_pred, by[i].score, by[i].rejected) == ("und", 0.0, True) for i in (1000, 1001, 1002))
    assert by[1003].lang_pred == "de" and by[None].lang_pred == "de" and all(0 <= r.score <= 1 for r in got)
    assert langid.identify(nothing, model).count() == 0
    empty = langid.fit_language_model(nothing)
    assert {r.lang_pred for r in langid.identify(df, empty).collect()} == {"und"}


def test_language_query_sample_is_bounded(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("the word").alias("text"), F.when(F.col("id") < 4990, "en").otherwise("xx").alias("lang"))
    rows = langid.labelled_sample(df, id_col="doc_id", text_col="text", lang_col="lang", max_rows=100)
    assert Counter(r[0] for r in rows) == {"en": 50, "xx": 10}


# 3 secrets


def brute_base(text):
    out = []
    kinds = (("assign", re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6), ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24))
    for order, (kind, pattern, keep) in enumerate(kinds):
        out += [(m.start(), order, m.end(), kind) for m in pattern.finditer(text) if keep(m)]
    return [(a, b, k) for a, _, b, k in sorted(out)]


PARTS = ["password", "PassWd", "secret", "tOken", "api_key", "APIKEY", '"', "'", ":", "=", " ", "\n", "abc", "abcdef", "x" * 30, "AKIA", "A1B2C3D4E5F6G7H8", "0123456789abcdef", "deadbeef" * 3, "K", "ſ", "\U0001f600", ".", "/"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14).map("".join))
def test_base_spans(text):
    assert secrets.base_spans(text) == brute_base(text)


def test_secrets(spark, docs, nothing):
    rng = random.Random(3)
    keys = ["".join(rng.choice(secrets.ENCODINGS[e]) for _ in range(n)) for e, n in (("base64", 40), ("base62", 32), ("base64url", 44), ("hex_upper", 40))]
    prose = [(1000 + i, "thionereronandtheationering andtheresofthewordsinthesetexts " * 3, "en", "s") for i in range(40)]
    rows = awkward() + prose + [(2000 + i, f"é see {k} there", "en", "s") for i, k in enumerate(keys)] + [(2010, "token = 04dbebab91ab85687d33eeaaf9ac699e1188f962", "en", "s")]
    got = {r.doc_id: r for r in secrets.secret_spans(frame(spark, rows)).collect()}
    for i, k in enumerate(keys):
        assert [(s.start, s.end) for s in got[2000 + i].random] == [(6, 6 + len(k))], k
    assert not any(r.random for i, r in got.items() if i is None or i < 2000)
    assert [(s.kind, s.start, s.end) for s in got[2010].base] == [("assign", 0, 48), ("hex", 8, 48)] and got[2010].random == []
    assert got[100].base == [] and secrets.secret_spans(nothing).count() == 0


def test_false_discovery_thresholds():
    null = {(b, k): 10 ** (4 - k) for b in range(2) for k in range(5)}
    assert max(secrets.thresholds({(b, 10 * k): n for (b, k), n in null.items()})) < 1e-4
    limits = secrets.thresholds({(0, 0): 1000, (0, 200): 10, (3, 200): 10})
    assert limits[0] >= 1e-20 and limits[3] > limits[0] and secrets.thresholds({}) == [0.0] * 8


# 4 token counts


def test_ledger(spark, tmp_path, nothing):
    import public_tokenizers

    paths = [public_tokenizers.path(n) for n in token_counts.TOKENIZERS]
    encodings = {token_counts.version_of(p): packing.byte_bpe(p) for p in paths}
    ledger = token_counts.TokenLedger(spark, str(tmp_path / "ledger"), paths)
    assert ledger.totals().count() == 0
    first = [(1, "one two", "en", "a"), (2, "drei vier", "de", "a"), (3, None, None, None), (4, "x" * 5000, "en", "b"), (4, "x" * 5000, "en", "b"), (None, "without", "en", "b"), (None, "without", "en", "b")]

    def expected(state):
        n, t = Counter(), Counter()
        for text, lang, source in state:
            for v, e in encodings.items():
                n[source, lang, v] += 1
                t[source, lang, v] += len(e.encode(text or ""))
        return {(k, n[k], t[k]) for k in n}

    def totals():
        return {((r.source, r.lang, r.tokenizer_version), r.n_docs, r.n_tokens) for r in ledger.totals().collect()}

    assert ledger.apply("b1", frame(spark, first))
    state = {1: ("one two", "en", "a"), 2: ("drei vier", "de", "a"), 3: (None, None, None), 4: ("x" * 5000, "en", "b"), "n": ("without", "en", "b")}
    assert totals() == expected(state.values())
    assert not ledger.apply("b1", frame(spark, first)) and totals() == expected(state.values())
    assert ledger.apply("b2", nothing) and totals() == expected(state.values())
    changes = spark.createDataFrame([(1, "one", "en", "c", True, 1), (1, "one two three", "en", "c", True, 2), (2, None, None, None, False, 1), (9, "gone before", "en", "a", False, 1), (5, "new", "fr", "a", True, 1)], "doc_id long, text string, lang string, source string, live boolean, seq long")
    assert ledger.apply("b3", changes, live_col="live", order_col="seq")
    state |= {1: ("one two three", "en", "c"), 5: ("new", "fr", "a")}
    del state[2]
    assert totals() == expected(state.values())
    assert ledger.apply("b4", frame(spark, [(2, "again", "de", "a")]))  # after its deletion
    state[2] = ("again", "de", "a")
    assert totals() == expected(state.values())
    # A batch that was broken off before its marker does not count, and is written anew.
    name = ledger.committed()[-1]
    import shutil

    shutil.rmtree(tmp_path / "ledger" / "commits" / name)
    del state[2]
    assert totals() == expected(state.values())
    assert ledger.apply("b4", frame(spark, [(2, "again", "de", "a")]))
    state[2] = ("again", "de", "a")
    assert totals() == expected(state.values())


def test_ledger_looks_up_stretches(spark, tmp_path, monkeypatch):
    """A batch of neighbours reads a share of the state, whatever lies elsewhere; a batch from everywhere reads no more than all."""
    import public_tokenizers

    monkeypatch.setattr(token_counts, "GROUP_BYTES", 1 << 10)
    ledger = token_counts.TokenLedger(spark, str(tmp_path / "ledger"), [public_tokenizers.path("byte_bpe_50k.tiktoken")])
    rows = [(i, f"text {i}", "en", "a") for i in range(20_000, 60_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    ledger.apply("all", docs)
    state = ledger.parts()

    def scanned(stretches):
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            plan = ledger._state(state, stretches)._jdf.queryExecution().executedPlan()
            plan.execute().count()
            return plan.collectLeaves().apply(0).metrics().apply("numOutputRows").value()
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", "true")

    ledger.apply("near", docs.where("doc_id BETWEEN 30000 AND 30399").withColumn("text", F.lit("other")))
    near = ledger.stretches(ledger.committed()[-1])
    assert near == [("30000", "30399")] and scanned(near) < 0.3 * len(rows)
    ledger.apply("far", docs.where("doc_id % 100 = 7"))
    far = ledger.stretches(ledger.committed()[-1])
    assert len(far) <= token_counts.STRETCHES and scanned(far) <= len(rows)
    assert ledger.stretches(ledger.committed()[-1], 1) == [("20007", "59907")]
    tokens = ledger.totals().first()
    encoding = packing.byte_bpe(packing.default_ranks())
    assert tokens.n_docs == len(rows) and tokens.n_tokens == sum(len(encoding.encode("other" if 30000 <= i <= 30399 and i % 100 != 7 else t)) for i, t, *_ in rows)
    ledger.apply("none", docs.limit(0))
    assert ledger.stretches(ledger.committed()[-1]) == [] and ledger.totals().first() == tokens


def test_token_query(spark, sf):
    got = QUERIES["op4_token_counts"](spark, sf).collect()
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert sum(r.n_docs for r in got) == 2 * n


# 5 language model


def brute_tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) + [None]


def test_scores(spark, docs, nothing):
    rows = awkward()
    train = [r for r in rows if r[0] != 7]
    counts = lm_scoring.count_grams(frame(spark, train), shards=5)
    c = Counter(t for r in train for t in brute_tokens(r[1]))
    n, v = sum(c.values()), len(c)
    assert (counts.tokens, counts.words) == (n, v)
    want = sorted((str(r[0]), len(t), sum(c[x] > 0 for x in t), round(sum(np.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t), 6)) for r in rows for t in [brute_tokens(r[1])])
    for more in ({}, {"max_filter_bytes": 4000, "heavy_words": 50}):
        got = lm_scoring.score_texts(frame(spark, rows), counts, **more).collect()
        assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
        scores = sorted((str(r.doc_id), r.n_tokens, r.score) for r in got)
        first = scores if not more else first
    assert scores == first and all(s <= 0 for *_, s in scores)
    assert lm_scoring.score_texts(nothing, counts).count() == 0
    none = lm_scoring.count_grams(nothing, shards=3)
    assert {r.n_known for r in lm_scoring.score_texts(frame(spark, rows[:3]), none).collect()} == {0}


def test_model_beats_unigrams(spark, sf):
    got = [r for r in QUERIES["op5_lm_score"](spark, sf).collect() if r.held_out]
    assert got and sum(r.score for r in got) > sum(r.base_score for r in got)


def test_filter_reads_back():
    rng = np.random.default_rng(0)
    hashes = np.unique(rng.integers(0, 1 << 63, 20000, dtype=np.uint64) * np.uint64(2))
    levels = rng.integers(1, 12, len(hashes))
    raw = lm_scoring.filled_slice(hashes, levels)
    held = lm_scoring.Filter([len(raw)], raw)
    found = held.levels(hashes)
    assert (found >= levels).all() and (found > levels).mean() < 0.05
    assert (held.levels(hashes + np.uint64(1)) > 0).mean() < 0.03
    assert (lm_scoring.Filter([0], b"").levels(hashes) == 0).all()


# 6 SimHash


def brute_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB ü\t\n Z\x1c", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


def brute_components(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(ids, 2):
        if linked(a, b):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("tile", [512, 4])
def test_close_fingerprints(spark, tile):
    rng = random.Random(2)
    fps = {rng.getrandbits(64) for _ in range(150)}
    for f in list(fps)[:20]:
        for _ in range(12):
            f ^= sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 4, 4, 5])))
            fps.add(f)
    signed = {f - (1 << 64) if f >> 63 else f for f in fps}
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = {r.node: r.root for r in simhash.fingerprint_components(df, tile=tile).collect()}
    want = brute_components(sorted(signed), lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1") <= 4)
    assert {f: got.get(f, f) for f in signed} == want


def test_near_duplicates(spark, docs, nothing):
    rows = awkward()
    prints = [brute_fingerprint(r[1]) for r in rows]
    got = simhash.near_duplicates(docs).collect()
    assert sorted((str(r.doc_id), r.fp % (1 << 64)) for r in got) == sorted((str(r[0]), p) for r, p in zip(rows, prints))
    root = brute_components(range(len(rows)), lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= 4)
    least = {}
    for i, r in enumerate(rows):
        least.setdefault(root[i], []).append(r[0])
    want = Counter((str(r[0]), str(min((x for x in least[root[i]] if x is not None), default=None))) for i, r in enumerate(rows))
    assert Counter((str(r.doc_id), str(r.component_id)) for r in got) == want
    left = simhash.drop_near_duplicates(docs)
    assert left.columns == docs.columns and left.count() == len(least)
    assert Counter(str(r.doc_id) for r in left.collect()) == Counter(str(min((x for x in v if x is not None), default=None)) for v in least.values())
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.drop_near_duplicates(nothing).count() == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1200)] + [(5000, i) for i in range(5001, 5400)] + [(7, 7), (8, 9), (8, 9)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = {tuple(sorted(e)) for e in edges}
    nodes = sorted({x for a, b in edges if a != b for x in (a, b)})
    assert got == brute_components(nodes, lambda a, b: (a, b) in near)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_forest_and_tiles(spark):
    assert forest(6, np.array([0, 4, 3]), np.array([4, 3, 1])).tolist() == [0, 0, 2, 0, 0, 5]
    members = spark.range(3000).select((F.col("id") % 2).alias("key"), F.col("id").alias("node"))
    star = link_in_tiles(members, lambda a, b: b - a == 2, tile=64)
    assert connected_components(star).select("root").distinct().count() == 2


# 7 lines


def test_lines(spark, docs, nothing):
    got = {(r.doc_id, r.kept_text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(docs, carry=True).collect()}
    rows = awkward()
    holders: dict = {}
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            key = line.strip(" \t\n\r\v\f").translate({c: c + 32 for c in range(65, 91)})
            if len(key) >= 20:
                holders.setdefault(key, set()).add(i)
    want = set()
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = []
        for line in lines:
            own = holders.get(line.strip(" \t\n\r\v\f").translate({c: c + 32 for c in range(65, 91)}), ())
            if len(own) < 3 or i == max(x for x in own if x is not None):
                kept.append(line)
        want.add((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    assert got == want
    assert line_dedup.dedup_lines(nothing).count() == 0 and line_dedup.dedup_lines(docs).count() == len(rows)


def test_line_length_is_in_code_points(spark):
    df = frame(spark, [(i, "é" * 19 + "\n" + "É" * 20 + "\n" + " x" * 10, "en", "s") for i in range(4)])
    assert {(r.doc_id, r.n_dropped) for r in line_dedup.dedup_lines(df).collect()} == {(0, 1), (1, 1), (2, 1), (3, 0)}


# 8 mixing


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.text("abcdef", min_size=1, max_size=3), st.floats(1e-4, 1), min_size=1, max_size=12), st.sampled_from([12, 50, 333]))
def test_pfair(weights, period):
    shares = mixing.shares_of(weights, period)
    given_ = dict.fromkeys(shares, 0)
    total = sum(shares.values())
    for slot, (s, k) in enumerate(mixing.pfair_period(shares), 1):
        assert given_[s] == k and (k * total) // shares[s] <= slot - 1 < -(-(k + 1) * total // shares[s])
        given_[s] += 1
        assert all(abs(given_[x] * total - slot * shares[x]) < total for x in shares)
    assert given_ == shares


def test_mix(spark, tmp_path, nothing):
    rows = [(i, "t", "en", s) for i, s in enumerate(["big"] * 700 + ["mid"] * 200 + ["low"] * 33 + [None] * 20)] + [(5, "t", "en", "big")] * 2
    path = str(tmp_path / "in")
    frame(spark, rows).write.parquet(path)
    df = spark.read.parquet(path)
    got = mixing.mix(df, {"big": 0.5, "mid": 0.25, "low": 0.2, "": 0.1}, block_rows=8, period=100).select("doc_id", "source", "mix_block", "mix_position").collect()
    blocks: dict = {}
    for r in got:
        blocks.setdefault(r.mix_block, []).append(r)
    assert len(got) == len(rows) and sorted(blocks) == list(range(len(blocks)))
    assert all(sorted(r.mix_position for r in b) == list(range(len(b))) and len({r.source for r in b}) == 1 for b in blocks.values())
    sizes = Counter(s for _, _, _, s in rows)
    assert Counter(b[0].source for b in blocks.values()) == {s: -(-n // 8) for s, n in sizes.items()}
    ordered = mixing.in_mix_order(df, {"big": 0.5}, block_rows=8, period=100)
    assert ordered.columns == df.columns and ordered.count() == len(rows) and {r.mix_block for r in ordered.collect()} == {"y"}
    frame(spark, []).write.parquet(str(tmp_path / "none"))
    assert mixing.in_mix_order(spark.read.parquet(str(tmp_path / "none"))).count() == 0


def test_phases_keep_to_targets():
    planned = mixing.phases({"a": 1000, "b": 50, "c": 400}, {"a": 0.5, "b": 0.2, "c": 0.3}, 100)
    assert [set(p["first"]) for p in planned] == [{"a", "b", "c"}, {"a", "c"}, {"a"}]


# 9 exact


def test_exact(spark, docs, nothing):
    rows = awkward()
    strip = lambda t: re.sub(r"[\x20\x09-\x0D]+", "", t or "")
    groups: dict = {}
    for i, t, *_ in rows:
        groups.setdefault(strip(t), []).append((i, len(t or "")))
    got = exact_groups(docs).collect()
    want = Counter()
    for i, t, *_ in rows:
        g = groups[strip(t)]
        keep = min(g, key=lambda x: (-x[1], x[0] is None, x[0] or 0))[0]
        want[str((i, keep, len(g), hashlib.sha256(strip(t).encode()).hexdigest()))] += 1
    assert Counter(str((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in got) == want
    assert sum(r.kept for r in got) == len(groups) and all(r.kept <= (r.doc_id == r.keep_id) for r in got)
    assert exact_groups(nothing).count() == 0


def test_exact_groups_over_many_partitions(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("the same ") * 1 if False else F.lit("the same text")).otherwise(F.concat(F.lit("t"), (F.col("id") % 50).cast("string"))).alias("text"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 23)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        got = exact_groups(df).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", True)
    assert {(r.keep_id, r.group_size) for r in got if r.doc_id % 3 == 0} == {(0, 2000)}
    assert sum(r.kept for r in got) == 51 and sum(r.group_size for r in got if r.kept) == 6000


# 10 vectors


def test_vectors(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(300):
        v = rng.normal(size=64)
        rows.append((i, v.tolist(), i % 3))
        for k in range(i % 4):
            near = v / np.linalg.norm(v) + rng.normal(size=64) * rng.uniform(0.01, 0.06)
            rows.append((1000 + 10 * i + k, (near * 7).tolist(), i % 3))
    rows += [(5000 + k, rows[0][1], 0) for k in range(5)] + [(6000, rows[0][1], None), (6001, None, 0), (6002, [0.0] * 64, 0), (6003, [float("nan")] + [1.0] * 63, 0), (6004, [None] + [1.0] * 63, 0), (6005, [], 0), (6006, rows[0][1][:32], 0), (6007, [float("inf")] + [1.0] * 63, 0), (6008, [x * 1e200 for x in rows[0][1]], 0)]
    df = spark.createDataFrame([(i, v, lab, "x", 1) for i, v, lab in rows], "vec_id long, embedding array<double>, label int, key string, node int")
    got = {r.vec_id: r for r in lattice.near_vectors(df, tile=8).collect()}
    assert len(got) == len(rows)

    def unit(v):
        if v is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        a = np.array(v) / np.abs(v).max()
        return a / np.linalg.norm(a)

    units = [unit(v) for _, v, _ in rows]
    links = {r[0]: set() for r in rows}
    for a, b in itertools.combinations(range(len(rows)), 2):
        x, y = units[a], units[b]
        if x is not None and y is not None and rows[a][2] is not None and rows[a][2] == rows[b][2] and len(x) == len(y) and x @ y >= 0.93:
            links[rows[a][0]].add(rows[b][0])
            links[rows[b][0]].add(rows[a][0])
    found, true = sum(r.n_links for r in got.values()), sum(map(len, links.values()))
    assert 0.98 * true <= found <= true and all(got[i].n_links <= len(links[i]) for i in links)
    for i, r in got.items():
        if r.n_links == len(links[i]) == 0:
            assert r.component_id == i and r.kept
    assert got[5004].component_id == 0 and not got[5004].kept and got[0].kept
    assert lattice.near_vectors(df.limit(0)).count() == 0


def test_lattice_decoding():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8)) * 3
    near = lattice.decode_e8(x)
    twice = (2 * near).astype(int)
    assert (np.abs(2 * near - twice) < 1e-9).all() and ((twice % 2 == twice[:, :1] % 2).all()) and (near.sum(1) % 2 == 0).all()
    others = near[:, None, :] + lattice.neighbours()[None]
    assert (((x[:, None, :] - others) ** 2).sum(2) >= ((x - near) ** 2).sum(1)[:, None] - 1e-9).all()


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=(400, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    z = rng.normal(size=a.shape)
    z -= (z * a).sum(1, keepdims=True) * a
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    b = 0.9301 * a + np.sqrt(1 - 0.9301**2) * z
    df = spark.createDataFrame([(int(i), v.tolist(), 1) for i, v in enumerate(np.concatenate([a, b]))], "vec_id long, embedding array<double>, label int")
    assert sum(r.n_links for r in lattice.near_vectors(df).collect()) >= 0.97 * 800
