from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from test_line_dedup import brute as brute_lines, frame, line, planted

from runhealth.llm import passages
from runhealth.llm.common import WORD


def brute(texts, min_words):
    """Words left of each text: later copies of stretches of min_words words go."""
    seen, left = set(), {}
    for k, text in texts.items():
        found, gone = (text or "").split(), set()
        for at in range(len(found) - min_words + 1):
            gram = tuple(found[at:at + min_words])
            if gram in seen:
                gone.update(range(at, at + min_words))
            seen.add(gram)
        left[k] = [w for i, w in enumerate(found) if i not in gone]
    return left


def across_lines():
    """Passages that begin and end inside lines, sit in one long line, or have other line breaks."""
    rng = random.Random(5)
    held = [line(rng, rng.randint(36, 70)).split() for _ in range(15)]
    common = line(rng, 22).split()
    texts = {}
    for i in range(90):
        found = line(rng, rng.randint(5, 30)).split() + rng.choice(held) + line(rng, rng.randint(1, 30)).split()
        if i % 3 == 0:
            found += common + line(rng, 12).split() + rng.choice(held)[5:]
        breaks = [rng.choice([" ", " ", " ", "  ", "\n", "\n\n"]) if i % 4 else " " for _ in found]
        texts[i] = "".join(w + b for w, b in zip(found, breaks))
    texts[90] = "a b c " * 60
    return texts


def test_passages_in_parts_of_lines_equal_brute_force(spark):
    texts = across_lines()
    got = {r["doc_id"]: r for r in passages.dedup_passages(frame(spark, texts)).collect()}
    want = brute(texts, passages.MIN_WORDS)
    assert {k: r["text"].split() for k, r in got.items()} == want
    assert sum(map(len, want.values())) < sum(len(t.split()) for t in texts.values())
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_query_takes_passages_inside_lines(spark, tmp_path):
    from runhealth.llm import queries

    texts = across_lines()
    frame(spark, texts).select("doc_id", "text", "lang", "source", "n_chars") \
        .write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["text"].split() for r in queries.QUERIES["op4_line_dedup"](spark, str(tmp_path)).collect()}
    assert got == brute(texts, passages.MIN_WORDS)


def test_whole_lines_go_as_before(spark):
    texts = planted()
    got = {r["doc_id"]: r["text"] for r in passages.dedup_passages(frame(spark, texts)).collect()}
    assert got == brute_lines(texts, passages.MIN_WORDS)


def test_edges(spark, edge_docs, edge_rows, no_docs):
    got = passages.dedup_passages(edge_docs).collect()
    assert len(got) == len(edge_rows)
    assert [r["text"] for r in got if r["doc_id"] == 64] == ["", ""]
    assert [r["text"] for r in got if r["doc_id"] == 50] == [None]
    assert passages.dedup_passages(no_docs).count() == 0


def without(text, spans):
    begins, ends = np.array(spans, int).reshape(-1, 2).T
    left, removed = passages.without(text.encode(), begins, ends)
    return left.decode(), removed


def test_space_around_deleted_words():
    text = "  a b  c d\n\ne f \n g h"
    assert without(text, [(1, 3)]) == ("  a d\n\ne f \n g h", 0)
    assert without(text, [(3, 5)]) == ("  a b  c\n\nf \n g h", 0)
    assert without(text, [(4, 6)]) == ("  a b  c d\n\n g h", 1)
    assert without(text, [(0, 1), (5, 7)]) == ("  b  c d\n\ne\n h", 0)


@pytest.mark.parametrize("size", [1, 5, 20, 40])
def test_window_hashes_follow_content(size):
    rng = np.random.default_rng(1)
    run = rng.integers(0, 1 << 60, 60).astype(np.uint64)
    a = passages.window_hashes(np.concatenate([rng.integers(0, 9, 7).astype(np.uint64), run]), size)
    b = passages.window_hashes(run, size)
    assert a[7:].tolist() == b.tolist() and len(set(b.tolist())) == len(b) == 61 - size


def hashes(text):
    data = text.encode()
    return passages.word_hashes(data, *passages.word_places(data)).tolist()


def test_word_hashes_do_not_depend_on_where_a_text_is_cut(monkeypatch):
    rng = random.Random(3)
    text = "".join(line(rng, rng.randint(1, 9)) + rng.choice(["\n", " \t", "\x0b", "\u00a0"]) for _ in range(60)) + " é \U0001f600"
    whole = hashes(text)
    assert whole == [hashes(w)[0] for w in re.findall(WORD, text)]
    assert len(set(whole)) == len(set(re.findall(WORD, text)))
    for piece in (30, 64, 1000):
        monkeypatch.setattr(passages, "PIECE", piece)
        assert hashes(text) == whole
    giant = "x" * 2000
    assert hashes("a " + giant + " b")[1:2] == hashes(giant) and hashes(giant) != hashes(giant + "x")


@pytest.mark.parametrize("width", [1, 2, 5, 21])
def test_least_is_the_last_of_the_smallest(width):
    grams = np.random.default_rng(width).integers(0, 6, 200).astype(np.uint64) << np.uint64(40)
    want = [max(range(i, i + width), key=lambda j: (-int(grams[j]), j)) for i in range(201 - width)]
    assert passages.least(grams, width).tolist() == want


@pytest.mark.parametrize("piece", [1, 500, 1 << 20])
def test_marks_do_not_depend_on_groups_of_documents(spark, monkeypatch, piece):
    texts = [*across_lines().values(), None, "", "one", " ".join(["same"] * 90)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string()),
                                        pa.array(range(len(texts)), pa.int64())], names=["doc_id", "text", "key"])
    want = {}
    for i, text in enumerate(texts):
        data = (text or "").encode()
        found = passages.word_hashes(data, *passages.word_places(data))
        grams = passages.window_hashes(found, 20)
        picked = [max(range(k, k + 21), key=lambda j: (-(int(grams[j]) >> 32), j)) for k in range(len(found) - 39)]
        runs = [k for k in range(len(picked)) if not k or picked[k] != picked[k - 1]]
        if runs:
            ends = [*runs[1:], len(picked)]
            want[i] = [(int(grams[picked[b]].view(np.int64)), b, e + 39 - b) for b, e in zip(runs, ends)]
    monkeypatch.setattr(passages, "PIECE", piece) if piece > 100 else None
    size = batch.num_rows if piece > 1 else 1
    parts = [batch.slice(at, size) for at in range(0, batch.num_rows, size)]
    got = {r["doc_id"]: list(zip(r["mark"], r["at"], r["reach"]))
           for out in passages._marked(40, 20)(iter(parts)) for r in out.to_pylist()}
    assert got == want


def test_deleted_words_against_line_by_line():
    def plain(text, gone):
        kept, at, removed = [], 0, 0
        for row in text.split("\n"):
            places = [m.span() for m in re.finditer(WORD, row)]
            lost = [at + i in gone for i in range(len(places))]
            at += len(places)
            if any(lost) and all(lost):
                removed += 1
                continue
            last = max((i for i, x in enumerate(lost) if not x), default=-1)
            for i in reversed(range(len(places))):
                if lost[i]:
                    row = row[:places[last][1]] if i > last else row[:places[i][0]] + row[places[i + 1][0]:]
            kept.append(row)
        return "\n".join(kept), removed

    rng = random.Random(8)
    for _ in range(300):
        text = "".join(rng.choice(["a", "bé", "\U0001f600"]) * rng.randint(0, 3) + rng.choice([" ", "  ", "\n", "\t", "\n\n"])
                       for _ in range(rng.randint(1, 30)))
        n = len(re.findall(WORD, text))
        spans = [(b, min(n, b + rng.randint(1, 6))) for b in rng.sample(range(n), min(n, rng.randint(1, 4)))]
        assert without(text, spans) == plain(text, {i for b, e in spans for i in range(b, e)})
