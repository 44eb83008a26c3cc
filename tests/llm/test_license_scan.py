"""License notices against base places word by word and edit distances of all word windows."""

import random
import re

import duckdb
import pytest

import __spark_entry__ as entry
from spendlens.llm import license_scan as ls

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_base(text):
    words = words_of(text)
    return sorted((i, label) for phrase, label in ls.BASE for i in range(len(words)) if words[i:i + len(phrase.split())] == phrase.split())


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain_labels(text):
    """Labels of notices that some run of words matches within the allowed edits."""
    words, found = words_of(text), set()
    for phrase, label in ls.NOTICES:
        k = ls.edits_allowed(phrase)
        for i in range(len(words)):
            for j in range(i + 1, len(words) + 1):
                part = " ".join(words[i:j])
                if len(part) > len(phrase) + k:
                    break
                if len(part) >= len(phrase) - k and distance(part, phrase) <= k:
                    found.add(label)
    return found


def spoiled(rng, phrase):
    text = list(phrase)
    for _ in range(rng.randint(0, 4)):
        at, how = rng.randrange(len(text)), rng.random()
        if how < 0.3:
            del text[at]
        elif how < 0.6:
            text.insert(at, rng.choice("aeinst é"))
        else:
            text[at] = rng.choice("aeinst é")
    return "".join(text)


@pytest.mark.parametrize("seed", range(6))
def test_labels_against_all_windows(seed):
    rng, scanner = random.Random(seed), ls.LicenseScanner()
    for _ in range(60):
        filler = ["the", "license", "mit", "public", "gnu", "é9", "x", "commons", "by", "cc"]
        parts = [rng.choice(filler) for _ in range(rng.randint(0, 6))]
        parts.insert(rng.randint(0, len(parts)), spoiled(rng, rng.choice(ls.NOTICES[:10])[0]))
        text = rng.choice([" ", ", ", " -\n"]).join(parts)
        text = text.upper() if rng.random() < 0.2 and text.isascii() else text
        n_words, base, findings = scanner.scan(text)
        assert n_words == len(words_of(text)) and base == plain_base(text)
        assert {f[0] for f in findings} == plain_labels(text), text
        for label, notice, first, last, edits, matched, start, end in findings:
            assert distance(matched, notice) <= edits <= ls.edits_allowed(notice)
            assert words_of(text)[first:last + 1] == matched.split(" ") == words_of(text[start:end])


def test_query_against_plain_form(spark):
    got = {r["doc_id"]: r for r in entry.queries()["op13_license_scan"](spark, SF).collect()}
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    assert len(got) == len(docs)
    for doc_id, text in docs:
        r, base = got[doc_id], plain_base(text)
        assert (r["n_words"], r["n_base"]) == (len(words_of(text)), len(base))
        assert (r["first_word"], r["last_word"]) == ((base[0][0], base[-1][0]) if base else (None, None))
        assert r["base_labels"] == ",".join(sorted({label for _, label in base})) and 0 <= r["score"] <= 1
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))


def test_odd_rows(spark):
    """Nulls, empty and very long texts, repeated ids, clashing names, an empty table."""
    long_text = "mit licence " * 20000 + "MIT License"
    texts = [(1, None), (1, ""), (None, "MIT license"), (2, "the Apache-Licence and CC BY-SA"), (2, "bit by bit"), (3, long_text), (4, "mitlicense\0")]
    df = spark.createDataFrame([(i, t, "base", 1, "f", 0.5) for i, t in texts], "doc_id long, text string, base string, n_words int, findings string, score double")
    scanned = ls.scan_licenses(df)
    got = sorted(map(tuple, ls.license_summary(scanned).collect()), key=str)
    assert got == sorted([
        (1, 0, 0, None, None, "", "", 0.0), (1, 0, 0, None, None, "", "", 0.0), (None, 2, 1, 0, 0, "mit", "mit", 1.0),
        (2, 7, 1, 4, 4, "cc-by", "apache,cc-by", 1.0), (2, 3, 0, None, None, "", "", 0.0), (3, 40002, 1, 40000, 40000, "mit", "mit", 1.0),
        (4, 1, 0, None, None, "", "mit", 1 - 1 / 11)], key=str)
    assert len(scanned.where("doc_id = 3").first()["findings"]) == 20001
    assert ls.license_summary(ls.scan_licenses(df.limit(0))).collect() == []
