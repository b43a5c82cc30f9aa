import pytest

from fieldloom.llm.truncation import ending, endings, judge, limits, skeleton, truncated_documents, truncation_rates
from fieldloom.plans.scale import table


@pytest.mark.parametrize("text, kind", [
    (None, "blank"), ("", "blank"), (" \n​", "blank"), ("It is done.", "terminal"), ('He said "done."', "terminal"), ("(A note: done.)", "terminal"), ("*Done!*", "terminal"), ("雨です。", "terminal"), ("More to follow...", "ellipsis"), ("cut he…", "ellipsis"),
    ("cut he… [+12 chars]", "explicit"), ("and then [truncated]", "explicit"), ("caf�", "half"), ("One sentence. And then it", "open"), ("netcdf x {\n a = 1", "open"), ("netcdf x {\n a = 1 ;\n}", "whole"), ("See:\n```\ncode()\n```", "whole"), ("See:\n```\ncode(", "open"),
    ("s | mean\nA | 1.0\nB | 2.0", "whole"), ("s | mean\nA | 1.0\nB", "open"), ("A title of few words", "short"), ("Fine.\n\nRegards\nThe team", "line"), ("List\n- one thing\n- two", "line"), ("Text.\n\nSource: https://a.example/b", "line"), ("2020-01-01 00:00:00 INFO all done", "line"), ("if(x[i]>=0){y+=x[i]*1e-3;}//ok", "whole"), ("a " * 20, "open")])
def test_endings(text, kind):
    assert ending(text).kind == kind


def test_skeletons():
    assert skeleton("Last checked: 2020-01-31") == "Last checked: 9999-99-99" and skeleton("Table 12: raw wind at Ab, 9.5 °C") == skeleton("Table 3: mean sea level at Cdef, 1.2 °C")


DOCS = "doc_id long, text string, source string, doc_type string, kind string, chars string"


def _corpus():
    rows = []
    for i in range(60):
        body = f"Station {i} reports values every {i} minutes and keeps them well. " * 30
        rows.append((i, body[:200], "limited", "post"))
        rows.append((1000 + i, body[:300 + 7 * i].rsplit(". ", 1)[0] + ".", "free", "post"))
        rows.append((2000 + i, f"All is well with number {i}.\n\nRegards\nThe archive team", "free", "post"))
        rows.append((3000 + i, "é" * (i % 2) + "x" * (i % 2) + "y" * (2 - i % 2) + "Große Höhen über dem Meer und mehr ohne Ende dabei " * 4, "bytes", "post"))
        rows.append((4000 + i, body[:117].rsplit(" ", 1)[0] + "…" if i % 2 else f"Short one {i}.", "marked", "post"))
    rows = [(i, t.encode()[:150].decode("utf-8", "replace") if s == "bytes" else t, s, k) for i, t, s, k in rows]
    rows += [(5001, "And so on...", "free", "post"), (5002, "It was cut in the mid", "free", "post"), (5003, None, "free", "post"), (5004, "", None, None), (5005, "A title", "free", "title"), (5006, "Well said.", None, None), (None, "Cut of", "free", "post")]
    return [(*r, "k", "c") for r in rows]


def test_judged(spark):
    docs = spark.createDataFrame(_corpus(), DOCS)
    got = {r.doc_id: r for r in judge(docs).collect()}
    assert all(got[i].truncated for i in range(60) if not _corpus()[5 * i][1].rstrip().endswith("."))
    assert not any(got[i].truncated for i in [*range(1000, 1060), *range(2000, 2060), 5001, 5003, 5004, 5005, 5006])
    assert got[5002].reason == "transfer" and all(got[4000 + i].reason == ("mark" if i % 2 else None) for i in range(60))
    assert sum(got[3000 + i].truncated for i in range(60)) == 60 and got[3001].reason == "limit"
    found = {r.source: r for r in limits(endings(docs)).collect()}
    assert found["limited"].char_limit == 200 and found["bytes"].byte_limit in (150, 151, 152) and found["marked"].mark_limit and found["free"].char_limit is None
    rates = {r.source: r for r in truncation_rates(docs).collect()}
    assert rates["marked"].n_truncated == 30 and rates["marked"].rate == 0.5 and rates["free"].n_transfer == 1
    assert truncated_documents(docs.limit(0)).count() == 0


def test_table(spark, data):
    docs = table(spark, data, "documents")
    judged = judge(docs)
    assert judged.count() == docs.count() and 0.05 < judged.where("truncated").count() / docs.count() < 0.35
