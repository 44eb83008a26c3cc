"""Exports in their own encodings and with their own headers."""

from spendlens.sources import exports

NAMES = {"plain.csv": ("utf-8", "અમદાવાદ"), "marked.csv": ("utf-8-sig", "Ünï"), "little.csv": ("utf-16", "ਊ\u0a0a\u010a x"),
         "bare_little.csv": ("utf-16-le", "ઊ"), "big.csv": ("utf-16-be", "\u0a0d\u0a0a"), "latin.csv": ("latin-1", "Café"), "ascii.csv": ("ascii", "cafe")}
FOUND = {"plain.csv": "UTF-8", "marked.csv": "UTF-8", "little.csv": "UTF-16LE", "bare_little.csv": "UTF-16LE", "big.csv": "UTF-16BE",
         "latin.csv": "ISO-8859-1", "ascii.csv": "UTF-8"}


def test_encodings_of_files(spark, tmp_path):
    for file, (encoding, name) in NAMES.items():
        end = "\r\n" if file in ("little.csv", "latin.csv") else "\n"
        lines = ["", "Campaign,clicks", *[f"{name} {i},{i}" for i in range(50)], "", f'"{name}, b",7']
        (tmp_path / file).write_bytes(end.join(lines).encode(encoding))
    (tmp_path / "empty.csv").write_bytes(b"")
    (tmp_path / "odd.csv").write_bytes("Campaign,clicks\nodd,1\n".encode("utf-16") + b"x")
    short = lambda path: path.rsplit("/", 1)[1]
    found = {short(r[0]): r[1] for r in exports.file_encodings(spark, str(tmp_path)).collect()}
    assert found == FOUND | {"odd.csv": "UTF-16LE"}
    got = sorted((short(r[exports.FILE]), r["Campaign"], r["clicks"]) for r in exports.read_ads_csv(spark, str(tmp_path)).collect())
    want = [(f, f"{n} {i}", str(i)) for f, (_, n) in NAMES.items() for i in range(50)] + [(f, f"{n}, b", "7") for f, (_, n) in NAMES.items()]
    assert got == sorted([*want, ("odd.csv", "odd", "1")])
    given = exports.read_ads_csv(spark, str(tmp_path / "little.csv"), "UTF-16LE")
    assert given.count() == 51


def test_many_headers_are_one_plan(spark, tmp_path):
    for i in range(120):
        (tmp_path / f"f{i}.csv").write_text(f"name,extra {i},Clicks,clicks,\nrow {i},{i},1,2,3,4\nshort {i}\n")
    rows = exports.read_ads_csv(spark, str(tmp_path))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Union") == 0 and plan.count("from_csv") + plan.count("csvtostructs") <= 2
    assert len(rows.columns) == 2 + 4 + 120  # name, Clicks, clicks3, _c4 and each file's extra
    got = {r["name"]: (r["extra 7"], r["extra 8"], r["Clicks"], r["clicks3"], r["_c4"]) for r in rows.collect()}
    assert len(got) == 240 and got["row 7"] == ("7", None, "1", "2", "3") and got["short 7"] == (None,) * 5


def test_client_column_of_each_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Account Name,clicks,brand\nX,1,b\n ,2,b\nnan,3,b\n")
    (tmp_path / "b.csv").write_text("clicks,BRAND\n4,Y\n")
    (tmp_path / "c.csv").write_text("clicks,note\n5,n\n")
    rows = exports.read_bulk(spark, str(tmp_path))
    assert "brand" in [c.lower() for c in rows.columns] and "Account Name" not in rows.columns
    assert sorted((r["clicks"], r["client"]) for r in rows.collect()) == [("1", "X"), ("4", "Y"), ("5", None)]
    named = exports.read_bulk(spark, str(tmp_path), "note")
    assert sorted((r["clicks"], r["client"]) for r in named.collect()) == [("1", "X"), ("4", "Y"), ("5", "n")]
    assert "client" not in exports.read_bulk(spark, str(tmp_path / "c.csv")).columns
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "e.csv").write_text("")
    assert exports.read_ads_csv(spark, str(tmp_path / "none")).count() == 0
