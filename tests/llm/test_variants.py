import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
import pyarrow as pa

from lociframe.llm import variants
from lociframe.llm.common import table

RUN = re.compile("[A-Za-zÀ-ÿ]+")
UPPER = {i: i + 32 for i in range(65, 91)}


def neighbours(word, letters):
    out = {word[:i] + word[i + 1 :] for i in range(len(word))}
    for c in letters:
        out |= {word[:i] + c + word[i:] for i in range(len(word) + 1)} | {word[:i] + c + word[i + 1 :] for i in range(len(word))}
    return out - {word}


def plain(rows, every=97, least_chars=5, least_count=3):
    """The words by the letter, with all possible edits looked up."""
    counts = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least_chars:
                counts[run] += 1
    counts = {w: n for w, n in counts.items() if n >= least_count}
    letters = set("".join(counts))
    form, near = {}, {}
    for w, n in counts.items():
        found = [x for x in neighbours(w, letters) if x in counts]
        near[w] = len(found)
        best = min(found, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= 2 * n else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n, near[w], form[w] and counts[form[w]]) for w, n in counts.items())


def got(spark, rows, **how):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, n int").repartition(3)
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in variants.group_variants(docs, **how).collect())


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_whole_table(spark, sf):
    docs = table(spark, f"/root/testdata/sf{sf}", "documents")
    want = plain([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    found = sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in variants.op13_variants(spark, f"/root/testdata/sf{sf}").collect())
    assert found == want and len(want) > 1000 and any(w[1] for w in want)


def test_odd_rows(spark):
    rng = random.Random(3)
    words = ["kolor", "kolör", "kolorr", "kolo", "olork", "Kolor", "k×lor", "ÿÿÿÿÿ", "ÿÿÿÿþ", "ab1cd", "straße", "strasse", "niño", "niños", "ninos", "Ābcde", "loser", "losers", "한글koloren"]
    rows = [(rng.choice([None, *range(40)]), rng.choice([" ", "\n", "-", "́", "9"]).join(rng.choices(words, k=rng.randrange(30)))) for _ in range(60)]
    rows += rows[:7] + [(1, None), (2, ""), (3, "×"), (4, "kolor " * 50_000 + "a" * 100_000 + " " + ("b" * 5000 + " ") * 3 + ("b" * 5001 + " ") * 7)]
    for every in (97, 2):
        assert got(spark, rows, every=every) == plain(rows, every)
    assert got(spark, []) == []
    assert got(spark, [(1, "one two")]) == []


def test_chain_and_ties(spark):
    rows = [(1, " ".join(["aaaaa"] * 3 + ["aaaab"] * 6 + ["aaabb"] * 12 + ["aabbb"] * 24 + ["abbbb"] * 48 + ["aaaac"] * 6 + ["zzzzz"] * 5))]
    found = {r[0]: r for r in got(spark, rows, every=10**9)}
    assert found["aaaaa"][1:3] == ("aaaab", "abbbb")  # aaaac has the same count
    assert found["zzzzz"][1:] == (None, "zzzzz", 5, 0, None)


@settings(max_examples=200, deadline=None)
@given(st.text("abcdeé", min_size=5, max_size=12), st.integers(0, 11), st.sampled_from("abcdeé"), st.sampled_from(["replace", "insert"]))
def test_near_words_share_a_signature(word, place, letter, how):
    place %= len(word)
    other = word[:place] + letter + word[place + (how == "replace") :]
    if other == word:
        return
    found = variants.signature_values(pa.array([word, other]), *variants.KINDS["same" if how == "replace" else "other"])
    assert (found[0] == found[1]).any()
