"""Texts that were cut off by a field limit or in transfer.

Each source's lengths, in characters and in bytes, are tested for a spike at their maximum: a field
limit. Texts of that length that don't end as a text does were cut there. An ellipsis tells a cut
only where the source's limit puts it; an explicit mark or half a character always does. Cuts in
transfer have no common length: they show as an ending that neither a sentence nor any of the
corpus' usual closing lines has (a closed brace, a signature, a table row, a log's last line).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.plans.scale import broadcast_if_small, spread, stored

#: A spike holds this share of its source's texts, and this many.
SPIKE_SHARE, SPIKE_LEAST = 0.02, 3
#: A spike lies in this upper part of the lengths.
SPIKE_TOP = 0.97
#: A cut at a word before the limit leaves at least this part of it.
BAND = 0.94
#: A closing line is usual if it makes up this share of all closing lines of its kind.
USUAL_SHARE, USUAL_LEAST = 0.01, 2
#: A last word is known if it stands this often inside closing lines, or ends this share of them.
WORD_LEAST, WORD_SHARE = 2, 0.002

_INVISIBLE = " \t\r\n\f\v\u0085 ­           ​‌‍    　﻿"
_TERMINAL = re.compile(r"[.!?。！？।؟۔…][\"'”’»)\]*_`]*$")
_ELLIPSIS = re.compile(r"(…|\.\.\.)$")
_EXPLICIT = re.compile(
    r"(?:\[\s*\+\s*\d[\d,.]*\s*(?:more\s+)?(?:chars?|characters|words|bytes)\s*(?:more)?\s*\]|[\[(<]\s*(?:text\s+)?(?:truncated|cut off|cut|continued|continues|snip|snipped|more|…|\.\.\.)\s*[\])>]|\b(?:read more|continue reading)\W{0,3})$", re.I)
_INNER = re.compile(r"[.!?。।]\s+\S")
_LOG = re.compile(r"^\[?\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?Z?\]?\s+")
_ITEM = re.compile(r"^\s*(?:[-*•]|\d{1,3}[.)])\s+\S")
_KEYED = re.compile(r"^[^\W\d_][\w -]{0,30}:\s+\S")
_PARTING = re.compile(r"^(?:--|__+|(?:best |kind |warm )?regards|best( wishes)?|cheers|thanks|sincerely|yours( truly| sincerely)?|cordialement|saluti|grüße|mit freundlichen grüßen),?$", re.I)
_CODE = re.compile(r"[;{}=<>\[\]&|]|//|\+=|->")
_LAST_WORD = re.compile(r"([^\W\d_]+)$")
_TOKENS = re.compile(r"[^\W\d_]+")


class Ending(NamedTuple):
    """How a text ends: ``kind`` is blank, terminal, ellipsis, explicit, half, whole, line, short or open."""

    kind: str
    form: str | None = None
    word: str | None = None
    inner: tuple[str, ...] = ()


def skeleton(line: str) -> str:
    """The form of a line: digits as 9, runs of lower-case words as w, capitalised words as W."""
    key, colon, rest = line.partition(": ") if _KEYED.match(line) else ("", "", line)
    rest = re.sub(r"\d", "9", rest)
    if "://" not in rest:
        rest = re.sub(r"\b[^\W\d_a-z]\w*", "W", rest)
        rest = re.sub(r"\b[^\W\d_A-Z][^\W\d_]*(?:[ -][^\W\d_A-Z][^\W\d_]*)*", "w", rest)
    else:
        rest = re.sub(r"[a-zA-Z]+", "a", rest)
        rest = re.sub(r"9+", "9", rest)
    return re.sub(r"\d+", "9", key) + colon + rest


def _cells(line: str) -> list[str]:
    return [re.sub(r"\d+", "9", c.strip()) for c in line.strip().strip("|").split("|")]


def ending(text: str | None) -> Ending:
    """Classify the end of a text; null, empty and blank texts are ``blank``."""
    t = (text or "").rstrip(_INVISIBLE)
    if not t:
        return Ending("blank")
    if t.endswith("�"):
        return Ending("half")
    if _EXPLICIT.search(t):
        return Ending("explicit")
    if _ELLIPSIS.search(t):
        return Ending("ellipsis")
    if _TERMINAL.search(t):
        return Ending("terminal")
    if t.count("```") % 2 or t.count("{") > t.count("}"):
        return Ending("open")
    if t.endswith("```") or t.endswith("}"):
        return Ending("whole")
    lines = t.split("\n")
    last = lines[-1].strip(_INVISIBLE)
    before = lines[-2].strip(_INVISIBLE) if len(lines) > 1 else None
    words = _TOKENS.findall(last)
    m = _LAST_WORD.search(last)
    word = m[1].lower() if m else None
    inner = tuple(w.lower() for w in (words[:-1] if word else words))
    if _LOG.match(last):
        return Ending("line", "log " + skeleton(_LOG.sub("", last)), word, inner)
    if "|" in last and before and "|" in before:
        above, here = _cells(before), _cells(last)
        same = len(above) == len(here) and here[-1] and (above[-1] == here[-1] or not re.search(r"\d", above[-1]) or not re.search(r"\d", here[-1]))
        return Ending("whole" if same else "open")
    if before is not None and _PARTING.match(before) and len(words) <= 6:
        return Ending("line", "parting", word, inner)
    if _ITEM.match(last):
        return Ending("line", "item", word, inner)
    if _INNER.search(last):
        return Ending("open")
    if re.fullmatch(r"https?://\S+", last):
        return Ending("line", skeleton(last), None, inner)
    if before is not None and _KEYED.match(last):
        return Ending("line", skeleton(last), word, inner)
    if len(_CODE.findall(last)) >= 4 and last.count("(") == last.count(")") and last.count("[") == last.count("]"):
        return Ending("whole")
    if before is None and len(last) <= 70 and len(words) <= 8:
        return Ending("short", None, word, inner)
    return Ending("open")


def endings(documents: DataFrame) -> DataFrame:
    """doc_id, source, doc_type, chars, bytes, kind, form, word, inner of every row with an id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc_id, source, kind, text in zip(b["doc_id"], b["source"], b["doc_type"], b["text"]):
                t = text if isinstance(text, str) else None
                e = ending(t)
                out.append((doc_id, source, kind, len(t) if t else 0, len(t.encode("utf-8", "surrogatepass")) if t else 0, e.kind, e.form, e.word, list(e.inner)))
            yield pd.DataFrame(out, columns=["doc_id", "source", "doc_type", "chars", "bytes", "kind", "form", "word", "inner"])

    return spread(documents.where("doc_id is not null").selectExpr("cast(doc_id as bigint) doc_id", "source", "doc_type", "text")).mapInPandas(
        run, "doc_id long, source string, doc_type string, chars int, bytes int, kind string, form string, word string, inner array<string>")


def limits(ends: DataFrame) -> DataFrame:
    """source, n_texts, char_limit, byte_limit, mark_limit of every source; a limit that no spike shows is null.

    Lengths are counted by source, in characters and in bytes. The top of a source is the greatest length
    within ``SPIKE_TOP`` below which enough texts end, so a few longer ones, kept whole or from before the
    limit, don't hide it. The spike is the most frequent length in that part, of which most texts don't end
    as a sentence; of characters and bytes the unit with the larger spike is the limit's. ``mark_limit`` is
    the top of a source of which the longest texts mostly end in an ellipsis. A null source counts as one
    without a name.
    """
    count = lambda c: F.sum(c.cast("long"))
    texts = ends.where("kind <> 'blank'").select(F.coalesce("source", F.lit("")).alias("source"), "kind", F.inline(F.expr("array(struct('chars' as unit, chars as size), struct('bytes' as unit, bytes as size))")))
    sizes = texts.groupBy("source", "unit", "size").agg(F.count(F.lit(1)).alias("n"), count(F.col("kind") == "ellipsis").alias("marked"), count(F.col("kind") != "terminal").alias("open"))
    # a row for each length that occurs: a source's window is bounded by its longest text
    source = Window.partitionBy("source", "unit")
    enough = f"greatest({SPIKE_LEAST}, n_texts * {SPIKE_SHARE})"
    sizes = sizes.withColumns({"n_texts": F.sum("n").over(source), "near": F.expr(f"sum(n) over (partition by source, unit order by ln(size) range between {-math.log(SPIKE_TOP)}D preceding and current row)")})
    sizes = sizes.withColumn("top", F.max(F.when(F.expr(f"near >= {enough}"), F.col("size"))).over(source)).where("size <= coalesce(top, size)")
    high, close = F.col("size") >= F.col("top") * SPIKE_TOP, F.col("size") >= F.col("top") * BAND
    per = sizes.groupBy("source", "unit").agg(
        F.max("n_texts").alias("n_texts"), F.max("top").alias("top"), F.max(F.when(high & (F.col("open") * 2 >= F.col("n")), F.struct("n", "size"))).alias("best"),
        F.sum(F.when(close, F.col("marked"))).alias("marked"), F.sum(F.when(close, F.col("n"))).alias("longest"))
    of = lambda unit, c: F.max(F.when(F.col("unit") == unit, F.col(c)))
    out = per.groupBy("source").agg(
        F.max("n_texts").alias("n_texts"), of("chars", "best.n").alias("n_chars"), of("chars", "best.size").alias("l_chars"), of("bytes", "best.n").alias("n_bytes"), of("bytes", "best.size").alias("l_bytes"),
        of("chars", "top").alias("top"), of("chars", "marked").alias("marked"), of("chars", "longest").alias("longest"))
    by_chars = F.coalesce("n_chars", F.lit(0)) >= F.coalesce("n_bytes", F.lit(0))
    return out.select(
        "source", "n_texts",
        F.when(F.expr(f"n_chars >= {enough}") & by_chars, F.col("l_chars")).alias("char_limit"),
        F.when(F.expr(f"n_bytes >= {enough}") & ~by_chars, F.col("l_bytes")).alias("byte_limit"),
        F.when((F.col("marked") >= SPIKE_LEAST) & (F.col("marked") >= F.col("longest") * 0.5), F.col("top")).alias("mark_limit"),
    )


def _closing_statistics(rows: DataFrame) -> DataFrame:
    """what, key, n, m: counts of closing lines, their forms and words, and of texts by type (m of them end as a sentence), by one aggregate.

    Texts of a limit's length are left out, but for the words inside of lines.
    """
    one = lambda what, key, ended="0": f"struct('{what}' as what, {key} as key, {ended} as ended)"
    free = F.expr(f"if(not at_limit, array({one('form', 'form')}, {one('total', chr(39) * 2)}, {one('final', 'word')}), array())")
    inside = F.expr(f"transform(inner, w -> {one('inside', 'w')})")
    by_type = F.expr(f"if(kind <> 'blank' and not at_limit, array({one('type', 'doc_type', 'if(kind in (' + repr('terminal') + ', ' + repr('ellipsis') + '), 1, 0)')}), array())")
    keys = F.concat(F.when(F.col("kind") == "line", F.concat(free, inside)).otherwise(F.expr("array()")), by_type)
    return rows.select(F.inline(keys)).where("key is not null").groupBy("what", "key").agg(F.count(F.lit(1)).alias("n"), F.sum("ended").alias("m"))


def judge(documents: DataFrame) -> DataFrame:
    """doc_id, source, truncated, reason (limit, mark or transfer; null if whole) of every row.

    Null, empty and blank texts are whole. A text of a field limit's length is whole if it ends as a
    sentence or a usual closing line does. Statistics cover all documents; rows that repeat are judged
    each. A null source counts as one without a name.
    """
    ends = stored(endings(documents))
    sources = stored(limits(ends).withColumnRenamed("source", "__source"))
    rows = ends.join(broadcast_if_small(sources), F.coalesce("source", F.lit("")) == F.col("__source"), "left").drop("__source")
    # half a character may count less or more bytes than what the limit cut off
    at_limit = F.coalesce(F.col("chars") == F.col("char_limit"), F.lit(False)) | F.coalesce(F.col("bytes").between(F.col("byte_limit") - 3, F.col("byte_limit") + 2), F.lit(False))
    at_mark = F.coalesce(F.col("chars") >= F.col("mark_limit") * BAND, F.lit(False))
    rows = rows.withColumns({"at_limit": at_limit, "at_mark": at_limit | at_mark})

    counts = stored(_closing_statistics(rows))
    total = (counts.where("what = 'total'").agg(F.sum("n")).first()[0] or 0)  # one number
    usual = counts.where((F.col("what") == "form") & (F.col("n") >= max(USUAL_LEAST, total * USUAL_SHARE))).select(F.col("key").alias("usual_form"))
    known = counts.where(((F.col("what") == "inside") & (F.col("n") >= WORD_LEAST)) | ((F.col("what") == "final") & (F.col("n") >= max(USUAL_LEAST, total * WORD_SHARE)))).select(F.col("key").alias("known_word")).distinct()
    prose = counts.where((F.col("what") == "type") & (F.col("m") >= F.col("n") * 0.5)).select(F.col("key").alias("__type"))

    # only closing lines meet their statistics; usual forms are at most 1 / USUAL_SHARE
    closed = rows.where("kind = 'line'").join(F.broadcast(usual), F.col("form") == F.col("usual_form"), "left").join(broadcast_if_small(known), F.col("word") == F.col("known_word"), "left")
    closed = closed.withColumn("closing", F.col("usual_form").isNotNull() & (F.col("word").isNull() | F.col("known_word").isNotNull())).select(*rows.columns, "closing")
    rows = closed.unionByName(rows.where("kind <> 'line'").withColumn("closing", F.lit(False)))
    rows = rows.join(broadcast_if_small(prose), F.col("doc_type") == F.col("__type"), "left")
    kind, line = F.col("kind"), F.col("kind") == "line"
    open_end = (kind == "open") | (line & ~F.col("closing")) | ((kind == "short") & (F.col("at_limit") | F.col("__type").isNotNull()))
    reason = (
        F.when(kind == "explicit", "mark")
        .when((kind == "ellipsis") & F.col("at_mark"), "mark")
        .when(kind == "half", F.when(F.col("at_limit"), "limit").otherwise("transfer"))
        .when(open_end, F.when(F.col("at_limit"), "limit").otherwise("transfer"))
    )
    return rows.select("doc_id", "source", reason.isNotNull().alias("truncated"), reason.alias("reason"))


def truncated_documents(documents: DataFrame) -> DataFrame:
    """doc_id of the texts that stop before their author's text did."""
    return judge(documents).where("truncated").select("doc_id").distinct()


def truncation_rates(documents: DataFrame) -> DataFrame:
    """source, n_documents, n_truncated, rate and the counts by reason of each source."""
    count = lambda r: F.sum((F.col("reason") == r).cast("long"))
    judged = judge(documents).groupBy("source").agg(
        F.count(F.lit(1)).alias("n_documents"), F.sum(F.col("truncated").cast("long")).alias("n_truncated"),
        *[F.coalesce(count(r), F.lit(0)).alias(f"n_{r}") for r in ("limit", "mark", "transfer")])
    return judged.withColumn("rate", F.col("n_truncated") / F.col("n_documents"))
