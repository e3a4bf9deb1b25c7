"""Operator 7: how many pairs it compares in large groups of near copies."""

import random

import pytest
from test_text_operators import brute_components

from presswork.llm import op7_jaccard as op7

SCHEMA = "doc_id long, text string"


def run(spark, monkeypatch, rows):
    seen, links = [], op7.links
    monkeypatch.setattr(op7, "links", lambda sets: links(sets, seen))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op7.jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()}
    monkeypatch.setattr(op7, "links", links)
    return got, {step: max(x[2] for x in seen if x[0] == step) for step in {x[0] for x in seen}}, seen


def changed(words, n, places=1):
    """n copies of one text, each with other words somewhere: copies link only where the changed places are near the ends."""
    rng, base = random.Random(words), [f"w{i}" for i in range(words)]
    rows = []
    for i in range(n):
        text = list(base)
        for place in rng.sample(range(words), places):
            text[place] = f"x{i}_{place}"
        rows.append((i, " ".join(text)))
    return rows


@pytest.mark.parametrize("words", [40, 110])
def test_pairs_grow_with_the_group(spark, monkeypatch, words):
    few, many = changed(words, 1000), changed(words, 5000)
    got, _, _ = run(spark, monkeypatch, few)
    assert got == brute_components(few)
    got, most, seen = run(spark, monkeypatch, many)
    # Verified pairs: a few for each copy, of 12.5 million.
    assert sum(n for step, n, _ in seen if step in ("partners", "rest")) <= 4 * len(many), seen
    assert most.get("rest", 0) <= len(many), seen


@pytest.mark.parametrize("places", [2, 3])
def test_few_tests_where_most_copies_do_not_link(spark, monkeypatch, places):
    rows = changed(100, 1200, places)
    got, _, seen = run(spark, monkeypatch, rows)
    words = [t.split() for _, t in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(96)} for w in words]
    links = sum(100 * len(a & b) >= 80 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    assert got == brute_components(rows)
    first = next(n for step, n, _ in seen if step == "open")
    assert sum(n for step, _, n in seen if step == "tested") <= 20 * links + 20 * first, seen


def test_passage_that_many_short_texts_share(spark, monkeypatch):
    """Texts that have most of their words from one passage, and don't link: no pair is compared."""
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(29)]
    rows = [(i, " ".join([*passage, *(f"u{i}_{k}" for k in range(rng.choice([5, 6, 7])))])) for i in range(1500)]
    got, _, seen = run(spark, monkeypatch, rows)
    assert len({c for _, c in got.values()}) == 1500 and sum(n for step, n, _ in seen if step != "open") == 0, seen
