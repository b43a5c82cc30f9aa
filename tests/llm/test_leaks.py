from itertools import combinations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldloom.llm.leaks import MASKS, RUN, Coder, Items, close_overlap, leaked_items, leaked_passages, overlap, window_hashes, words_of
from fieldloom.plans.scale import table


def _brute(doc_words, item_words, n=12):
    grams = {tuple(item_words[i:i + n]) for i in range(len(item_words) - n + 1)}
    return any(tuple(doc_words[i:i + n]) in grams for i in range(len(doc_words) - n + 1))


def test_words():
    assert words_of("Ab_c d2É; éx  ①") == ["ab", "c", "d2é", "éx", "①"] and words_of(None) == [] and words_of("") == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=60), st.lists(st.sampled_from("abc"), min_size=12, max_size=40), st.integers(0, 30), st.integers(0, 40))
def test_exact_runs(doc, item, at, n):
    doc = doc[:at] + item[:n] + doc[at:]
    group = Items([7], [item])
    found = any(overlap(doc, item, s)[0] >= 12 for _, s in group.diagonals(Coder().codes(doc))) if len(doc) >= 12 else False
    assert found == _brute(doc, item)


def test_masks_tolerate_substitutions():
    item = [f"w{i}" for i in range(40)]
    doc = list(item)
    for i in (5, 17, 29):
        doc[i] = "changed"
    assert (0, 0) in Items([1], [item]).diagonals(Coder().codes(doc))
    assert overlap(doc, item, 0)[:3] == (11, 40, 3)
    assert all(m[0] == 0 and m[-1] == 11 for m in MASKS) and len(window_hashes(np.zeros(11, np.uint64), MASKS[0])) == 0


def test_documents(spark):
    passage = " ".join(f"word{i}" for i in range(14))
    docs = spark.createDataFrame([
        (1, "before " + passage.upper().replace(" ", ",  ") + " after", "x"), (2, passage.replace("word6 ", ""), "x"), (3, None, "x"), (4, "", "x"), (1, passage, "x"), (5, passage.replace("word2", "other"), "x"), (None, passage, "x"), (6, ("filler " * 50_000) + passage, "x")],
        "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(10, passage, "s", "d"), (11, None, "s", "d"), (12, "too short", "s", "d"), (None, passage, "s", "d"), (13, passage + " and more", "s", "d")], "item_id int, item_text string, suite string, doc_id string")
    want = {(d, i) for d in (1, 6) for i in (10, 13)}
    assert {(r.doc_id, r.item_id) for r in leaked_items(docs, items).collect()} == want
    # items too many to be held are joined, or read in blocks
    assert {(r.doc_id, r.item_id) for r in leaked_items(docs, items, held_chars=1).collect()} == want
    assert sorted(map(tuple, leaked_passages(docs, items, held_chars=200).collect())) == sorted(map(tuple, leaked_passages(docs, items).collect()))
    near = {r.doc_id: r for r in leaked_passages(docs, items).where("item_id = 10").collect()}
    assert near[5].exact_words == 11 and near[5].overlap_words <= 14
    assert leaked_items(docs, items.limit(0)).count() == 0 and leaked_items(docs.limit(0), items).count() == 0


def test_table(spark, data):
    docs, items = table(spark, data, "documents"), table(spark, data, "eval_items")
    held = [(r.item_id, words_of(r.item_text)) for r in items.collect()]
    want = {(r.doc_id, i) for r in docs.collect() for w in [words_of(r.text)] for i, x in held if _brute(w, x)}
    assert {(r.doc_id, r.item_id) for r in leaked_items(docs, items).collect()} == want


def _close(doc, item):
    """Diagonals with a window of at least 12 words of which at most a fourth is changed, by trying all."""
    found = set()
    for shift in range(12 - len(item), len(doc) - 11):
        same = [doc[i + shift] == item[i] for i in range(max(0, -shift), min(len(item), len(doc) - shift))]
        if any(4 * same[a:b].count(False) <= b - a for a in range(len(same)) for b in range(a + 12, len(same) + 1)):
            found.add((0, shift))
    return found


def test_all_altered_passages():
    for n in (12, 13, 16):
        item = [f"w{i}" for i in range(n)]
        for changed in combinations(range(n), n // 4):
            doc = ["x", *("changed" if i in changed else w for i, w in enumerate(item)), "y"]
            fitting, runs = Items([1], [item], RUN).alike(Coder().codes(doc))
            assert fitting == [(0, 1)] and runs[0] == max(len(r) for r in "".join("x" if i in changed else "w" for i in range(n)).split("x"))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=40), st.lists(st.sampled_from("abc"), min_size=12, max_size=30))
def test_close_overlaps(doc, item):
    fitting, _ = Items([1], [item], RUN).alike(Coder().codes(doc))
    assert set(fitting) == _close(doc, item)
    for _, shift in fitting:
        _, n, changed, at, begin = close_overlap(doc, item, shift)
        assert n >= 12 and 4 * changed <= n and at - begin == shift and changed == sum(doc[at + i] != item[begin + i] for i in range(n))


def test_altered_rows(spark):
    words = [f"w{i}" for i in range(12)]
    patterns = [c for c in combinations(range(12), 3)]
    docs = spark.createDataFrame([(k, " ".join("changed" if i in c else w for i, w in enumerate(words))) for k, c in enumerate(patterns)] + [(-1, " ".join(["changed"] * 4 + words[4:]))], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(words))], "item_id int, item_text string")
    rows = leaked_passages(docs, items).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(patterns)))
