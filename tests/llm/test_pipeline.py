from __future__ import annotations

import inspect
import re
import struct
from collections import Counter, defaultdict

import pytest

import corpus_pipeline as pipeline
from runhealth.llm import mixing, near_dups, passages, quality


@pytest.fixture(scope="module")
def tables(spark, small, tmp_path_factory):
    home = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    found = [docs]
    for name, stage in pipeline.STAGES:
        path = str(home / name.replace(" ", "-"))
        stage(spark, found[-1], small).write.parquet(path)
        found.append(spark.read.parquet(path))
    return found


def texts(frame):
    return {r["doc_id"]: r["text"] for r in frame.collect()}


def test_stage_functions_and_columns(tables):
    assert len(pipeline.STAGES) == 5
    for _, stage in pipeline.STAGES:
        assert list(inspect.signature(stage).parameters) == ["spark", "docs", "sf_dir"]
    for frame in tables[1:-1]:
        assert frame.dtypes == tables[0].dtypes


def test_quality_keeps_what_the_rules_keep(tables):
    judged = {d: quality.measure(t, quality.Rules()) for d, t in texts(tables[0]).items()}
    assert texts(tables[1]) == {d: m[7] if m[8] else texts(tables[0])[d] for d, m in judged.items() if m[6]}


def test_line_stage_keeps_documents_and_drops_later_copies_word_by_word(tables):
    before, after = texts(tables[1]), texts(tables[2])
    assert before.keys() == after.keys()
    seen = set()
    for d in sorted(before):
        words, gone = re.findall(mixing.WORD, before[d] or ""), set()
        for at in range(len(words) - passages.MIN_WORDS + 1):
            stretch = tuple(words[at:at + passages.MIN_WORDS])
            if stretch in seen:
                gone.update(range(at, at + passages.MIN_WORDS))
            seen.add(stretch)
        assert re.findall(mixing.WORD, after[d] or "") == [w for i, w in enumerate(words) if i not in gone]
    assert any(before[d] != after[d] for d in before)


def test_near_stage_leaves_no_pair_and_no_orphan(tables):
    before, after = texts(tables[2]), texts(tables[3])
    assert after.items() <= before.items()

    def alike(a, b):
        if not a.strip() or not b.strip():
            return not a.strip() and not b.strip()
        return near_dups.similarity(a, b) >= 0.8

    left = sorted(after)
    assert not any(alike(after[a], after[b]) for i, a in enumerate(left) for b in left[:i])
    gone = set(before) - set(after)
    assert all(any(alike(before[g], before[d]) for d in before if d != g) for g in gone)


def test_mixing_stage_meets_targets(tables):
    docs = tables[3].collect()
    sizes, taken = Counter(), Counter()
    for r in docs:
        sizes[r["source"]] += len(re.findall(mixing.WORD, r["text"] or ""))
    for r in tables[4].collect():
        taken[r["source"]] += len(re.findall(mixing.WORD, r["text"]))
    order = sorted(sizes)
    for s, want in zip(order, mixing.targets([sizes[s] for s in order])):
        assert abs(taken[s] - want) <= mixing.BLOCK_WORDS + 1


def test_packing_stage_holds_every_text(tables):
    whole = defaultdict(list)
    for r in tables[5].collect():
        assert len(r["ids"]) == 4 * r["length"] and 1 << r["bucket"] == r["length"]
        whole[r["doc_id"]].append(r["length"])
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(pipeline.tokenizer_path()).encode
    want = Counter()
    for r in tables[4].collect():
        want[r["doc_id"]] += len(encode(r["text"], add_special_tokens=False).ids) + 1
    assert {d: sum(n) for d, n in whole.items()} == want
    assert struct.calcsize("<I") == 4


def test_run_equals_the_stages(spark, small, tables):
    got = Counter((r["doc_id"], r["start"], bytes(r["ids"])) for r in pipeline.run(spark, small).collect())
    assert got == Counter((r["doc_id"], r["start"], bytes(r["ids"])) for r in tables[5].collect())


def test_empty_documents(spark, no_docs):
    docs = no_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in pipeline.STAGES:
        frame = stage(spark, docs, "")
        assert frame.count() == 0
