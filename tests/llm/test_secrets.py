"""The randomness battery, the columns of the query, and tokens of great length."""

from __future__ import annotations

import hashlib
import random
import re
import resource

import numpy as np
import pytest

from sievework.llm import secrets
from sievework.llm.queries import QUERIES

ORDINARY = [
    "getUserAccountSettingsByIdAndRegion", "/usr/local/lib/python3/site-packages/numpy", "en_US_2026-11-27_report_final_v2", "123e4567-e89b-42d3-a456-426614174000",
    "0f8fad5b-d9cb-469f-a165-70867728950e", "MAX_NUMBER_OF_CONNECTIONS_PER_HOST", "2026-11-27_2026-11-28_2026-11-29", "org/apache/hadoop/fs/FileSystem/listStatus", "the-quick-brown-fox-jumps-over-the-lazy-dog",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "0123456789" * 6, "a" * 40, "handleRequestTimeoutExceptionWithRetry", "test_that_documents_without_words_are_kept", "20261127103000_20261128103000",
]


@pytest.fixture(scope="module")
def prose(sf):
    import duckdb

    counts, changes, pairs = np.zeros(256, np.int64), 0, 0
    for (text,) in duckdb.sql(f"select text from '{sf}/documents.parquet'").fetchall():
        raw = np.frombuffer((text or "").encode(), np.uint8)
        counts += np.bincount(raw, minlength=256)
        changes, pairs = (a + b for a, b in zip((changes, pairs), secrets._changes(secrets._CLASS[raw])))
    return secrets.Prose(counts, changes, pairs)


def test_ordinary_tokens_are_not_random(prose):
    assert all(secrets.battery(t, prose)[1] > 0.05 for t in ORDINARY)


@pytest.mark.parametrize(("encoding", "length", "most"), [("base62", 40, 1e-3), ("base64", 64, 1e-6), ("base64url", 48, 1e-3), ("hex_upper", 40, 1e-3), ("lower_alnum", 64, 1e-3), ("base32", 128, 1e-2), ("decimal", 512, 1e-4)])
def test_random_keys_are(prose, encoding, length, most):
    rng = random.Random(3)
    found = [secrets.battery("".join(rng.choices(secrets.ENCODINGS[encoding], k=length)), prose)[1] for _ in range(50)]
    assert sorted(found)[40] < most


def test_words_joined_keep_the_rate(prose, sf):
    """Names made of the corpus's own words: p below x comes no more often than x."""
    import duckdb

    words = [w.lower() for (t,) in duckdb.sql(f"select text from '{sf}/documents.parquet'").fetchall() for w in re.findall("[A-Za-z]{2,}", t or "")][:200000]
    rng, styles, found = random.Random(5), [lambda w: "_".join(w), lambda w: w[0] + "".join(x.title() for x in w[1:]), lambda w: "/".join(w), lambda w: "-".join(w)], []
    for _ in range(2000):
        found.append(secrets.battery(rng.choice(styles)([rng.choice(words) for _ in range(rng.randint(5, 9))]).ljust(20, "e"), prose)[1])
    assert all(np.mean(np.array(found) <= x) <= x for x in (0.3, 0.1, 0.03, 0.01))


def test_spans_of_a_corpus(spark):
    rng = random.Random(7)
    keys = ["".join(rng.choices(secrets.ENCODINGS["base62"], k=48)) for _ in range(20)]
    prose = "the plain words of a text that says very little about anything at all and goes on "
    rows = [(i, f"{prose * 6} {k} {prose}") for i, k in enumerate(keys)] + [(100 + i, f"{prose} {t} {prose}") for i, t in enumerate(ORDINARY)]
    rows.append((200, f"token={keys[0]}/{keys[1]} and password: abcdef"))
    got = {r.doc_id: r for r in secrets.secret_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = dict(rows)
    assert sum([texts[i][s.start : s.end] for s in got[i].random] == [k] for i, k in enumerate(keys)) >= 18
    assert not any(got[100 + i].random for i in range(len(ORDINARY)))
    assert [s.kind for s in got[200].base] == ["assign", "assign"]


def test_query(spark, sf):
    got = {r.doc_id: r for r in QUERIES["op3_secret_scan"](spark, sf).collect()}
    forms = {
        "assign": (r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6),
        "access": ("(AKIA[A-Z0-9]+)", 20), "hex": ("([0-9a-f]+)", 24),
    }
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    assert got.keys() == docs.keys()
    for i, text in docs.items():
        want = sorted((m.start(), list(forms).index(k), m.end(), k) for k, (form, least) in forms.items() for m in re.finditer(form, text) if len(m[1]) >= least)
        told = ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
        assert got[i].base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(k == n for *_, k in want) for n in forms]
        assert [x for x in got[i].spans.split(",") if x and not x.startswith("random")] == [x for x in told.split(",") if x]


def test_long_token(prose):
    token = "".join(map(chr, np.random.default_rng(1).choice(np.frombuffer(secrets.ENCODINGS["base64"].encode(), np.uint8), 20_000_000)))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert secrets.battery(token, prose) == ("base64", 0.0)
    assert secrets.candidates("x " + token, [])
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 600_000  # kB
