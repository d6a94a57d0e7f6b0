import hashlib
import random
import re

from lociframe.llm import linedup


def plain(rows):
    """(id, text) -> new text by the letter."""
    docs = sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(r[1].encode()).hexdigest()))
    seen, out = set(), {}
    for i, t in docs:
        lines = t.split("\n")
        full = [k for k, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x)]
        gone = set()
        for a in zip(full, full[1:], full[2:]):
            window = tuple(lines[k] for k in a)
            if window in seen:
                gone |= set(a)
            seen.add(window)
        out[i, t] = ("\n".join(x for k, x in enumerate(lines) if k not in gone), len(gone))
    return out


def check(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, row_key string, n_removed int").repartition(4)
    got = linedup.remove(docs, count="n_removed")
    assert set(got.columns) == set(docs.columns)
    want = plain(rows)
    assert sorted(((r.doc_id, r.text, r.n_removed) for r in got.collect()), key=str) == sorted(((i, *want.get((i, t), (t, 0))) for i, t in rows), key=str)
    assert linedup.remove(docs).columns == docs.columns


def test_by_the_letter(spark):
    rng = random.Random(1)
    lines = ["a", "b", "c", "", " ", "d  ", "A", "é"]
    rows = [(rng.choice([None, *range(60)]), "\n".join(rng.choices(lines, k=rng.randrange(12)))) for _ in range(80)]
    check(spark, [*rows, *rows[:5], (99, None), (98, ""), (97, "\n"), (96, "a\nb\nc\n" * 3), (95, "x\ny"), (94, "x\ny")])


def test_long_text_and_hot_window(spark):
    hot = "one\ntwo\nthree\nfour"
    rows = [(i, f"own {i}\n{hot}\nend {i}") for i in range(300)]
    rows.append((1000, "\n".join(f"line {k % 20_000}" for k in range(60_000))))
    check(spark, rows)
    assert linedup.remove(spark.createDataFrame([], "doc_id long, text string")).count() == 0
