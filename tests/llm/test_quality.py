from __future__ import annotations

import re
from collections import Counter

import duckdb
import pytest

from runhealth.llm import quality

RULES = quality.Rules()


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    often = Counter(grams)
    covered = {j for i, g in enumerate(grams) if often[g] > 1 for j in range(i, i + 5)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            sum(x in lines[:i] for i, x in enumerate(lines)), len(covered),
            len(words) < 10 or 100 * len(covered) > 20 * len(words))


def test_base_figures_equal_brute_force(edge_docs, edge_rows):
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"],
                   r["base_failed"]) for r in quality.judge_documents(edge_docs).collect())
    assert got == Counter((doc_id, *brute(text)) for doc_id, text, *_ in edge_rows)


def test_a_failed_base_is_never_kept(edge_docs):
    assert quality.judge_documents(edge_docs).where("base_failed and kept").count() == 0


@pytest.mark.parametrize("line, rule", [
    ("", None), ("A plain line of text.", None), ("Title without a stop", None), ("Home | News | Sport | Contact", "navigation"),
    ("*** ### $$$ %%%", "punctuation"), ("- - -", "punctuation"), ("Copyright 2020. All rights reserved.", "boilerplate"),
    ("Licensed under the Apache License, Version 2.0.", None), ("Das ist für uns gut.", None)])
def test_line_rules(line, rule):
    assert quality.failing_rule(line, RULES) == rule


def test_failing_lines_go_and_heavy_losers_are_rejected(spark):
    good = "\n".join(["A line that says something useful here."] * 1 + ["Home | News | Sport | Contact", "Another line that stays, as it should."])
    bad = "\n".join(["Menu | One | Two | Three | Four | Five | Six"] * 1 + ["Menu | Eins | Zwei | Drei | Vier | x", "a few words stay"])
    frame = spark.createDataFrame([(1, good, "en", "s", len(good)), (2, bad, "en", "s", len(bad))],
                                  "doc_id long, text string, lang string, source string, n_chars long")
    left = quality.keep_good(frame).collect()
    assert [r["doc_id"] for r in left] == [1]
    assert "Home" not in left[0]["text"] and left[0]["n_chars"] == len(left[0]["text"])


def test_labelled_documents(spark, small):
    """Held-out accuracy: nothing was fitted to the labels."""
    path = small.replace("0.001", "0.1")
    labels = {d: q for d, q in duckdb.sql(f"select doc_id, quality from '{path}/labels.parquet'").fetchall()}
    got = quality.judge_documents(spark.read.parquet(f"{path}/documents.parquet")).select("doc_id", "kept", "base_failed").collect()
    right = Counter((labels[r["doc_id"]], r["kept"]) for r in got if r["doc_id"] in labels and not r["base_failed"])
    assert right[1, True] >= 0.98 * (right[1, True] + right[1, False])
    assert right[0, False] >= 0.8 * (right[0, True] + right[0, False]), right


def test_empty_table(no_docs):
    assert quality.judge_documents(no_docs).count() == quality.keep_good(no_docs).count() == 0
