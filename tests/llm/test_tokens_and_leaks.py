"""Tokens: exact round trip. Leaked items: planted passages."""

import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docketeer.llm import leaked_items as L
from docketeer.llm import tokenize_corpus as K

needs_file = pytest.mark.skipif(not os.path.exists(K.DEFAULT_RANKS), reason="no rank file")


@needs_file
def test_round_trip_and_empty(spark):
    texts = ["Hello  world\n\n", "", None, "naïve 👩‍⚖️ <|endoftext|> ​ x", "a" * 5000, " "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids = K.encode(df)
    out = {r.doc_id: r.ids for r in ids.collect()}
    assert out[1] == [] and out[2] == [] and len(out) == 6
    assert {r.doc_id: r.text for r in K.decode(ids).collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert K.encode(df.limit(0)).count() == 0


@needs_file
@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab1 9\n\t'sé漢.,- "), max_size=300))
def test_cutting_changes_no_id(text):
    assert K.encode_text(text, part_chars=7) == K.encode_text(text)
    assert "".join(K.safe_parts(text, 7)) == text


def items():
    rng = random.Random(1)
    return [(i, " ".join(f"w{rng.randrange(400)}" for _ in range(80))) for i in range(12)]


def test_planted_passages(spark):
    rng = random.Random(2)
    its, docs, want = items(), [], set()
    for k in range(60):
        filler = [f"f{rng.randrange(900)}" for _ in range(60)]
        item, text = its[k % 12]
        words = text.split()
        n = (16, 25, 60, 80, 8)[k % 5]
        at = rng.randrange(80 - n + 1)
        part = words[at : at + n]
        if n >= 25:
            part[10] = "changed"
            del part[18]
        joined = " ".join(part).upper() if k % 2 else ",\n".join(part)
        docs.append((k, " ".join(filler[:30]) + " " + joined + " " + " ".join(filler[30:])))
        if n >= 15:
            want.add((k, item))
    docs += [(100, None), (101, ""), (102, "short")]
    found = L.find_passages(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(its + [(99, "too short"), (98, None)], "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want


def test_search_equals_brute_force():
    rng = random.Random(3)
    its = [(i, [f"w{rng.randrange(6)}" for _ in range(15)]) for i in range(4)]
    text = [f"w{rng.randrange(6)}" for _ in range(400)]
    want = {(i, a, t) for i, ws in its for a in range(len(ws) - 4) for t in range(len(text) - 4) if ws[a : a + 5] == text[t : t + 5]}
    assert set(L.WuManber(its).search(text)) == want


def test_broken_words():
    assert L.words_of("The chan-\ndler's Loom") == ["the", "chandler", "s", "loom"]


def test_a_quotation_counts_with_stray_words_at_its_end():
    item = [f"w{k}" for k in range(40)]
    exact = item[10:25]
    search = L.WuManber([(1, item)])
    # 16 of 18 agree over the whole stretch, 15 of 15 without its end
    stray = ["x"] * 9 + exact + ["y", "z", item[27]] + ["x"] * 9
    assert L.passages(search, stray, 15) == [(1, 15, 10, 15, 15)]
    # the same at its beginning
    assert L.passages(search, ["x"] * 9 + [item[7], "y", "z", *exact] + ["x"] * 9, 15) == [(1, 15, 10, 15, 15)]
    # 14 words are too few
    assert L.passages(search, ["x"] * 9 + exact[:14] + ["y", "z", "q"] + ["x"] * 9, 15) == []
