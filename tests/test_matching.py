import random

from spendlens.functions.medians import exact_medians
from spendlens.operators import matching


def brute(names, keys, min_length, prefer_exact):
    out = {}
    for client, name in names:
        mine = [(k, o) for c, k, o in keys if c == client]
        if prefer_exact and any(k == name for k, _ in mine):
            out[client, name] = name
            continue
        hits = [(o, k) for k, o in mine if k == name or (min(len(k), len(name)) >= min_length and (k in name or name in k))]
        if hits:
            out[client, name] = min(hits)[1]
    return out


def test_first_match_against_brute_force(spark):
    rng = random.Random(7)
    words = ["brand", "promo", "shop", "search", "x1", "x12", "retarget", "q"]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 4)))
    names = sorted({(rng.randint(1, 3), text()) for _ in range(120)})
    keys = sorted({(rng.randint(1, 3), text()) for _ in range(80)})
    keys = [(c, k, i) for i, (c, k) in enumerate(rng.sample(keys, len(keys)))]
    left = spark.createDataFrame(names, "client_id int, name string")
    right = spark.createDataFrame(keys, "client_id int, key string, place int")
    for min_length, prefer in ((1, True), (10, True), (1, False)):
        got = matching.first_match(left, right, ["client_id"], "name", "key", "place", min_length, prefer)
        assert {(r["client_id"], r["name"]): r["key"] for r in got.collect()} == brute(names, keys, min_length, prefer)


def test_short_names_do_not_match_web_traffic(spark):
    left = spark.createDataFrame([(1, "Brand"), (1, "Brand Performance")], "client_id int, name string")
    right = spark.createDataFrame([(1, "brand performance max", 1), (1, "bran", 0)], "client_id int, key string, place int")
    got = matching.first_match(left, right, ["client_id"], "name", "key", "place", 10)
    assert {r["name"]: r["key"] for r in got.collect()} == {"brand performance": "brand performance max"}


def test_exact_medians_with_one_dominant_group(spark):
    rng = random.Random(3)
    rows = [("hot", float(rng.choice([0, 1, 1, 5, rng.gauss(0, 100)]))) for _ in range(3000)]
    rows += [("a", 4.0), ("a", 1.0), ("b", -2.5), ("b", 2.5), ("b", 7.0), ("c", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = dict(exact_medians(df, ["k"], ["v"]).collect())

    def median(values):
        s = sorted(values)
        return (s[(len(s) - 1) // 2] + s[len(s) // 2]) / 2

    assert got["a"] == 2.5 and got["b"] == 2.5 and "c" not in got
    assert got["hot"] == median([v for k, v in rows if k == "hot"])


def test_new_clients_that_begin_alike_are_numbered_in_order(spark):
    names = [(f"Client {i:03d}",) for i in range(300)] + [("Known",), ("client 005",)]
    clients = spark.createDataFrame([(7, "known")], "client_id long, client_name string")
    got = {r["bulk_name"]: r["client_id"] for r in matching.resolve_clients(spark.createDataFrame(names, "client_name string"), clients).collect()}
    assert got.pop("Known") == 7 and got.pop("client 005") == got["Client 005"]
    assert [got[f"Client {i:03d}"] for i in range(300)] == list(range(8, 308))
