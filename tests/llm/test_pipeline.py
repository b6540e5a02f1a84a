"""The pipeline, stage by stage, against plain versions of what each stage decides."""

from __future__ import annotations

import itertools
import re

import pytest

import corpus_pipeline as pipeline
from sievework.llm import packing


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, out[-1], sf).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_names_and_columns(stages):
    assert [n for n, _ in pipeline.STAGES] == ["language", "lines", "duplicates", "mix", "pack"]
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_language_keeps_clean_documents(stages):
    before, after = ({r.doc_id: r.text for r in s.collect()} for s in stages[:2])
    assert all(before[i] == t for i, t in after.items())
    gone = [before[i] for i in before.keys() - after.keys()]
    assert len(gone) <= 0.02 * len(before) and not any(re.search(r"\w{3}.*\w{3}.*\w{3}.*\w{3}", t) for t in gone)


def test_lines(stages):
    before, after = ({r.doc_id: r for r in s.collect()} for s in stages[1:3])
    assert before.keys() == after.keys() and all(r.n_chars == len(r.text) for r in after.values())
    holders: dict = {}
    for i, r in before.items():
        for line in r.text.split("\n"):
            key = line.strip(" \t\n\r\v\f")
            if len(key) >= 20:
                holders.setdefault(key.lower(), set()).add(i)
    for i, r in before.items():
        kept = [x for x in r.text.split("\n") if len(h := holders.get(x.strip(" \t\n\r\v\f").lower(), ())) < 3 or max(h) == i]
        assert after[i].text == "\n".join(kept)


def test_duplicates(stages):
    """Five-word shingles, a similarity of 0.8 or more: every two documents are compared."""
    before, after = ({r.doc_id: r for r in s.collect()} for s in stages[2:4])
    ids, sets = sorted(before), {}
    for i in ids:
        w = re.findall(r"[^\x20\x09-\x0D]+", before[i].text.translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(ids, 2):
        if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert set(after) == {find(i) for i in ids} and all(before[i] == r for i, r in after.items())


def test_mix_keeps_all(stages):
    assert sorted(r.doc_id for r in stages[3].collect()) == sorted(r.doc_id for r in stages[4].collect())


def test_pack(stages):
    encoding = packing.byte_bpe(packing.default_ranks())
    want = {r.doc_id: len(packing.document_ids(encoding, r.text)) for r in stages[4].collect()}
    held, sequences = dict.fromkeys(want, 0), {}
    texts = {r.doc_id: r.text for r in stages[4].collect()}
    for r in stages[5].collect():
        assert r.ids == packing.document_ids(encoding, texts[r.doc_id])[r.start : r.start + r.length].tobytes()
        held[r.doc_id] += r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert held == want
    for pieces in sequences.values():
        pieces.sort()
        assert [a for a, _ in pieces] == list(itertools.accumulate([0] + [n for _, n in pieces]))[:-1] and sum(n for _, n in pieces) <= 1024


def test_run(spark, sf, stages):
    assert sorted(map(str, pipeline.run(spark, sf).select("doc_id", "piece", "ids_crc32").collect())) == sorted(map(str, stages[5].select("doc_id", "piece", "ids_crc32").collect()))
