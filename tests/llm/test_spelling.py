"""Spelling variants against all pairs, counts against a loop over the texts."""

import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from spendlens.llm import spelling

SF = "/root/testdata/sf0.001"
SCHEMA = "word string, doc_id long, text string, n string, key int, near string"


def plain_vocabulary(docs, least_n=5):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= least_n}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    short, long = sorted((a, b), key=len)
    i = next((i for i, (x, y) in enumerate(zip(short, long)) if x != y), len(short))
    return short[i:] == long[i + 1:] if len(short) < len(long) else short[i + 1:] == long[i + 1:]


def plain_forms(counts):
    out = {}
    for w, n in counts.items():
        around = [v for v in counts if near(w, v)]
        best = min(around, key=lambda v: (-counts[v], v), default=None)
        form = best if best and counts[best] >= 5 * n else None
        out[w] = [form, n, len(around), counts[form] if form else None]
    rows = set()
    for w, (form, n, n_near, form_n) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.add((w, form, root, n, n_near, form_n))
    return rows


COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def rows(df):
    got = [tuple(r[c] for c in COLUMNS) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_query_against_plain_form(spark):
    query = entry.queries()["op12_spelling_variants"](spark, SF)
    assert query.columns[:6] == COLUMNS and [t for _, t in query.dtypes[:6]] == ["string"] * 3 + ["bigint"] * 3
    counts = plain_vocabulary(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())
    got = {r[0]: r for r in rows(query)}
    assert {w: r[3] for w, r in got.items()} == counts
    some = dict(sorted(counts.items())[:1500])  # all pairs of a slice of the vocabulary
    sliced = spelling.spelling_forms(spark.createDataFrame(list(some.items()), "word string, n long"))
    assert rows(sliced) == plain_forms(some)


@pytest.mark.parametrize("symbols", [1, 3, 6])
def test_forms_against_all_pairs(spark, symbols):
    rng = random.Random(4)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(5, 8))): rng.choice([1, 5, 25, 125, 700, 700]) for _ in range(400)}
    words |= {"a": 5, "b": 25, "ab": 125, "y" * 500: 1, "y" * 501: 5, "y" * 502: 25}  # a chain, and one longer than any key
    df = spark.createDataFrame([(n, w, "extra") for w, n in words.items()] + [(3, None, "extra")], "n long, word string, key string")
    assert rows(spelling.spelling_forms(df, symbols=symbols)) == plain_forms(words)


def test_neighbourhoods_hold_every_edit():
    rng = random.Random(1)
    for _ in range(300):
        w = "".join(rng.choice("abcdefghÿ") for _ in range(rng.randint(1, 9)))
        at, c = rng.randrange(len(w)), rng.choice("abcdefghÿz")
        for v in (w[:at] + w[at + 1:], w[:at] + c + w[at:], w[:at] + c + w[at + 1:], w + c):
            assert spelling.reduced_key(v, 6) in spelling.neighbour_keys(w, 6)


def test_vocabulary_of_odd_texts(spark, monkeypatch):
    long_text = "lengthy Words÷withÉ " * 3000 + "z" * 5000
    docs = [(i, "Straße straße STRASSE colour, colour: COLOUR x") for i in range(40)]
    docs += [(None, "nobody nobody nobody nobody nobody"), (None, None), (3, ""), (4, long_text), (4, long_text)]
    df = spark.createDataFrame([("w", i, t, "n", 1, "x") for i, t in docs], SCHEMA)
    assert {r["word"]: r["n"] for r in spelling.vocabulary(df).collect()} == plain_vocabulary(docs)
    monkeypatch.setattr(spelling, "PIECE", 7)
    assert [w for some in spelling.runs("abc defghijklm, Nop÷qĀr") for w in some] == ["abc", "defghijklm", "nop÷q", "r"]


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert spelling.vocabulary(none).collect() == []
    assert spelling.spelling_forms(spelling.vocabulary(none)).collect() == []
