"""Every opN_ query over the smallest tables, against the columns it promises and plain versions of its rules."""

from __future__ import annotations

import itertools
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from sievework.llm import langid, mixing, packing, simhash, token_counts
from sievework.llm.exact_dedup import exact_groups
from sievework.llm.queries import QUERIES

COLUMNS = {
    "op1_best_fit_packing": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op2_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op3_secret_scan": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op5_lm_score": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op6_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op7_line_dedup": {"doc_id": "bigint", "n_lines": "bigint", "n_dropped": "bigint", "kept_sha256": "string"},
    "op9_exact_dedup": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
    "op10_embedding_dedup": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op11_exact_topk": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
    "op12_centroid_clusters": {"vec_id": "bigint", "cluster": "int", "distance": "bigint", "cluster_inertia": "bigint", "inertia": "bigint", "centroid_sha256": "string"},
    "op13_embedding_whitening": {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"},
}


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").collect()


def crc(i, of):
    return zlib.crc32(str(i).encode()) % of


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, sf, name):
    kinds = {f.name: f.dataType.simpleString() for f in QUERIES[name](spark, sf).schema}
    assert {c: kinds.get(c) for c in COLUMNS[name]} == COLUMNS[name]


def test_op1(spark, sf, docs):
    encoding = packing.byte_bpe(packing.default_ranks())
    ids = {r.doc_id: [*encoding.encode(r.text or "", allowed_special="all"), 2] for r in docs}
    own, sequences = {}, {}
    for r in QUERIES["op1_best_fit_packing"](spark, sf).collect():
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
        own.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, pieces in own.items():
        pieces.sort()
        n = len(ids[i])
        assert [p for p, _, _ in pieces] == list(range(-(-n // 1024))) and sum(k for *_, k in pieces) == n
        assert [s for _, s, _ in pieces] == [0, *itertools.accumulate(k for *_, k in pieces)][:-1] and all(k == 1024 for _, _, k in pieces[1:])
    for held in sequences.values():
        held.sort()
        assert [a for a, _ in held] == [0, *itertools.accumulate(n for _, n in held)][:-1] and sum(n for _, n in held) <= 1024
    bins: list[int] = []  # best fit, one piece at a time
    for n in sorted((k for p in own.values() for *_, k in p), reverse=True):
        fits = [i for i, room in enumerate(bins) if room >= n]
        if fits:
            bins[min(fits, key=lambda i: bins[i])] -= n
        else:
            bins.append(1024 - n)
    assert len(sequences) == len(bins) and own.keys() == ids.keys()


def test_op5_rows(spark, sf, docs):
    """Every row of the query against a plain count of all training words."""
    lower = str.maketrans({c: c + 32 for c in range(65, 91)})
    tokens = {r.doc_id: [*re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate(lower)), None] for r in docs}
    c = Counter(t for i, ts in tokens.items() if crc(i, 10) for t in ts)
    n, v = sum(c.values()), len(c)
    got = QUERIES["op5_lm_score"](spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        ts = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc(r.doc_id, 10) == 0, len(ts), sum(c[t] > 0 for t in ts), n)
        assert abs(r.base_score - sum(np.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts)) < 1e-6 * max(1.0, -r.base_score)
        assert r.score <= 0


def test_op2(spark, sf, docs):
    got = {r.doc_id: r for r in QUERIES["op2_language_id"](spark, sf).collect()}
    assert got.keys() == {r.doc_id for r in docs}
    for r in docs:
        g = got[r.doc_id]
        assert g.held_out == (crc(r.doc_id, 4) == 2) and 0 <= g.score <= 1
        if not r.text or not re.search(r"[^\W\d_]", r.text):
            assert (g.lang_pred, g.score) == ("und", 0.0)
    sure = [r for r in docs if r.lang and got[r.doc_id].held_out and len(re.findall(r"[^\W\d_]{2,}", r.text or "")) >= 5]
    assert len(sure) > 20 and np.mean([got[r.doc_id].lang_pred == r.lang for r in sure]) >= 0.97


def test_op4(spark, sf, docs):
    import public_tokenizers

    want = Counter()
    for name in token_counts.TOKENIZERS:
        path = public_tokenizers.path(name)
        encoding, version = packing.byte_bpe(path), token_counts.version_of(path)
        for r in docs:
            want[r.source, r.lang, version, "docs"] += 1
            want[r.source, r.lang, version, "tokens"] += len(encoding.encode(r.text or "", allowed_special="all"))
    got = {}
    for r in QUERIES["op4_token_counts"](spark, sf).collect():
        got |= {(r.source, r.lang, r.tokenizer_version, "docs"): r.n_docs, (r.source, r.lang, r.tokenizer_version, "tokens"): r.n_tokens}
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}


def test_op6(spark, sf, docs):
    got = {r.doc_id: r for r in QUERIES["op6_simhash"](spark, sf).collect()}
    prints = {r.doc_id: simhash.fingerprint((r.text or "").encode()) for r in docs}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(prints, 2):
        if (prints[a] ^ prints[b]).bit_count() <= 4:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert {i: r.component_id for i, r in got.items()} == {i: find(i) for i in prints}


def plain_edf(blocks, weights):
    """Each slot looks at every source: the released block with the earliest deadline, then the larger weight, then the name."""
    left, out = {s: n for s, n in blocks.items() if n}, []
    while left:
        whole = sum(Fraction(str(weights[s])) for s in left)
        w = {s: Fraction(str(weights[s])) / whole for s in left}
        given, start = dict.fromkeys(left, 0), len(out)
        while all(given[s] < left[s] for s in left):
            t = len(out) - start
            ready = [s for s in left if given[s] / w[s] // 1 <= t]
            s = min(ready, key=lambda s: (-(-(given[s] + 1) / w[s] // 1), -w[s], s))
            out.append(s)
            given[s] += 1
        left = {s: n - given[s] for s, n in left.items() if n > given[s]}
    return out


def test_op8(spark, sf, docs):
    rows = Counter(r.source for r in docs)
    got = QUERIES["op8_source_mix"](spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in docs)
    slots: dict = {}
    for r in got:
        slots.setdefault(r.mix_block, []).append(r)
    assert all(len({r.source for r in b}) == 1 and sorted(r.mix_position for r in b) == list(range(len(b))) for b in slots.values())
    weights = {f"s{s}": n**0.7 for s, n in rows.items()}
    want = plain_edf({f"s{s}": -(-n // 16) for s, n in rows.items()}, weights)
    assert [f"s{slots[k][0].source}" for k in range(len(slots))] == want


def test_many_sources_keep_to_their_targets():
    rng = random.Random(1)
    weights = {f"s{i:03}": rng.choice([0.0001, 0.013, 0.2, 1.7]) for i in range(499)} | {"large": 300.0}
    total = sum(Fraction(str(w)) for w in weights.values())
    first = mixing.phases({s: 10**6 if s == "large" else 2000 for s in weights}, weights)[0]["slots"]
    n = sum(len(v) for v in first.values())
    assert n > 200_000
    for s, at in first.items():  # just before and just after each of its blocks a source is farthest from its target
        share = Fraction(str(weights[s])) / total
        for k in range(0, len(at), max(1, len(at) // 300)):
            assert abs(k - share * int(at[k])) < 1 and abs(k + 1 - share * (int(at[k]) + 1)) < 1


def test_slots_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLOTS", 8)
    rows = [(i, "a" if i % 3 else "b") for i in range(1000)]
    got = mixing.mix(mixing.stored(spark.createDataFrame(rows, "doc_id long, source string"), "mix-test")).collect()
    assert sorted({r.mix_block for r in got}) == list(range(1 + max(r.mix_block for r in got))) and max(r.mix_block for r in got) < 10 and len(got) == 1000


def test_ledger_merges_parts(spark, tmp_path):
    import public_tokenizers

    rng, path = random.Random(2), public_tokenizers.path(token_counts.TOKENIZERS[0])
    encoding = packing.byte_bpe(path)
    ledger = token_counts.TokenLedger(spark, str(tmp_path / "l"), [path], merge=2)
    state: dict = {}
    for k in range(5):
        changes = {i: None if rng.random() < 0.3 else ("word " * rng.randint(0, 9), rng.choice("ab")) for i in rng.sample(range(30), 12)}
        rows = [(i, c and c[0], "en", c and c[1], c is not None) for i, c in changes.items()]
        assert ledger.apply(f"b{k}", spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, live boolean"), live_col="live")
        state = {i: c for i, c in (state | changes).items() if c}
        want: Counter = Counter()
        for text, source in state.values():
            want[source, "docs"] += 1
            want[source, "tokens"] += len(encoding.encode(text))
        got = {(r.source, x): v for r in ledger.totals().collect() for x, v in (("docs", r.n_docs), ("tokens", r.n_tokens))}
        assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}
        assert len(ledger.parts()) <= 2
    assert not ledger.apply("b0", spark.createDataFrame([], "doc_id long, text string, lang string, source string"))


def test_long_texts_are_hashed_whole(monkeypatch):
    text = "Straße und über " * 400
    whole = np.sort(langid.subwords(text))
    monkeypatch.setattr(langid, "_WINDOW", 100)
    assert np.array_equal(np.sort(langid.subwords(text)), whole) and sum(1 for _ in langid.subword_parts(text)) > 100
    model = langid.LanguageModel(["a", "b"], np.random.default_rng(0).normal(size=(1 << langid.BITS, 2)), np.zeros(2), 1.0, 0.0)
    parts = model.predict(text)
    monkeypatch.setattr(langid, "_WINDOW", 1 << 18)
    assert parts[0] == model.predict(text)[0] and parts[1] == pytest.approx(model.predict(text)[1])


def test_every_language_is_learned(spark):
    rows = [(i, f"{'xyz'[i % 3]}{chr(97 + i % 26)}{i % 300} word", f"l{i % 300:03}") for i in range(1200)]
    sample = langid.labelled_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), id_col="doc_id", text_col="text", lang_col="lang", max_rows=600)
    assert Counter(r[0] for r in sample) == dict.fromkeys([f"l{i:03}" for i in range(300)], 4)
    same = spark.createDataFrame([(None, "same text", "en")] * 5000 + [(1, "other", "fr")], "doc_id long, text string, lang string")
    assert Counter(r[0] for r in langid.labelled_sample(same, id_col="doc_id", text_col="text", lang_col="lang")) == {"en": 1, "fr": 1}


def test_exact_with_many_rows_of_one_identifier(spark):
    rows = [(None, "same  text")] * 9000 + [(7, "same text")] * 9000 + [(8, "other")]
    got = exact_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == {(None, None, 18000): 9000, (7, None, 18000): 9000, (8, 8, 1): 1} and sum(r.kept for r in got) == 2
