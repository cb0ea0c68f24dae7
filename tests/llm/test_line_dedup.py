from __future__ import annotations

import random

import numpy as np
import pytest

from runhealth.llm import line_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long, at int, lines string"


def line(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))


def brute(texts, min_words):
    """Delete every line of a stretch of min_words words or more of which an earlier copy exists.

    Shortest stretches from each line on, and up to each line, cover all longer ones.
    """
    units = {k: [(i, x.split()) for i, x in enumerate((t or "").split("\n")) if x.split()] for k, t in texts.items()}
    seen, gone = set(), {k: set() for k in texts}
    for k, lines in units.items():
        sizes = [len(w) for _, w in lines]
        for end in range(len(lines)):
            for begin in range(end, -1, -1):
                n = sum(sizes[begin:end + 1])
                if n >= min_words:
                    shortest = n - sizes[begin] < min_words or n - sizes[end] < min_words
                    if not shortest:
                        break
                    gram = tuple(" ".join(w) for _, w in lines[begin:end + 1])
                    if gram in seen:
                        gone[k] |= {number for number, _ in lines[begin:end + 1]}
                    seen.add(gram)
    return {k: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[k]) if t else t for k, t in texts.items()}


def planted():
    rng = random.Random(11)
    passages = [[line(rng, rng.randint(3, 25)) for _ in range(rng.randint(3, 8))] + [line(rng, 30)] for _ in range(12)]
    common = line(rng, 9)
    texts = {}
    for i in range(60):
        lines = [line(rng, rng.randint(1, 20)) for _ in range(rng.randint(1, 15))] + [common]
        rng.shuffle(lines)
        if i % 2:
            at = rng.randrange(len(lines))
            lines[at:at] = [x.replace(" ", "  ") if i % 3 == 0 else x for x in rng.choice(passages)]
        if i % 5 == 0:
            lines.insert(0, "")
        texts[i] = "\n".join(lines)
    texts[60] = texts[3]
    texts[61] = "\n".join(passages[0] + ["between"] + passages[0])
    texts[62], texts[63], texts[64], texts[65] = None, "", " \n\t\n", line(rng, 500)
    texts[66] = texts[65]
    texts[67] = "\n".join([line(rng, 12)] * 30)
    return texts


def frame(spark, texts):
    return spark.createDataFrame([(k, t, "en", "s", len(t) if t is not None else None, 1, "z") for k, t in texts.items()], DOCS)


@pytest.mark.parametrize("salt", [20_000, 7])
def test_equals_brute_force(spark, monkeypatch, salt):
    monkeypatch.setattr(line_dedup, "SALT_ROWS", salt)
    texts = planted()
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(frame(spark, texts)).collect()}
    want = brute(texts, line_dedup.MIN_WORDS)
    assert {k: r["text"] for k, r in got.items()} == want
    assert want[60] == "" and want[66] == "" and want[3] != ""
    assert all(r["n_chars"] == len(r["text"]) for r in got.values() if r["n_removed"])


def test_windows_select_by_content():
    rng = np.random.default_rng(1)
    for _ in range(200):
        run_h, run_c = rng.integers(0, 9, 12).astype(np.uint64) << np.uint64(40), rng.integers(1, 15, 12).astype(np.int32)
        if run_c.sum() < 40:
            continue
        marks = []
        for _ in range(2):
            n, m = rng.integers(0, 10, 2)
            h = np.concatenate([rng.integers(0, 1 << 60, n), run_h, rng.integers(0, 1 << 60, m)]).astype(np.uint64)
            c = np.concatenate([rng.integers(1, 15, n), run_c, rng.integers(1, 15, m)]).astype(np.int32)
            marks.append({p - n for p in line_dedup.fingerprints(h, c, 40) if 0 <= p - n < 12})
        assert marks[0] & marks[1]


def test_edges(edge_docs, edge_rows, no_docs):
    got = line_dedup.dedup_lines(edge_docs).collect()
    assert len(got) == len(edge_rows)
    twins = [r["text"] for r in got if r["doc_id"] == 64]
    assert len(twins) == 2 and twins[0] == twins[1] == ""
    assert [r["text"] for r in got if r["doc_id"] == 50] == [None]
    assert line_dedup.dedup_lines(no_docs).count() == 0




def test_runs_around_a_line_that_all_texts_share(spark):
    """The common line is the minimum of most windows, and neither its first nor its preceding holder has the run."""
    rng = random.Random(3)
    common = min((line(rng, 9) for _ in range(200)), key=lambda x: line_dedup.line_hashes(x)[1][0] >> np.uint64(1))
    passages = [[line(rng, 17), common, line(rng, 18), line(rng, 3)] for _ in range(20)]
    texts = {}
    for i in range(120):
        texts[i] = "\n".join([line(rng, 8), *passages[(i * 7) % 20 if i % 3 else i % 20], line(rng, 11), common])
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(frame(spark, texts)).collect()}
    assert got == brute(texts, line_dedup.MIN_WORDS)
    lone = line_dedup.stretches(*line_dedup.line_hashes(texts[0])[1:], line_dedup.MIN_WORDS, [])
    assert list(lone) == []
