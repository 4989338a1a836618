"""Operator 11 against plain code."""

import math
import random

import duckdb
import numpy as np
from llm_samples import SMALL
from pyspark.sql import functions as F
from shelfscope.llm import queries, rns_negatives

VECTORS = "vec_id long, embedding array<double>, label int, codes string, block int, anchor long, rank int"


def plain(rows, label=lambda r: r[2]):
    """All pairs, in Python's own whole numbers."""
    rows = {(r[0], label(r), tuple(math.floor(256 * x) for x in r[1])) for r in rows if usable(r)}
    found = []
    for a in rows:
        if a[0] % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(a[2], r[2])), r[0], r[1] == a[1]) for r in rows]
        for ps, p, _ in sorted(s for s in scored if s[2] and s[1] != a[0])[:5]:
            fit = sorted((ns, n) for ns, n, same in scored if not same and 30 * -ps <= 100 * -ns <= 90 * -ps)[:10]
            found += [(a[0], p, i, n, -ps, -ns) for i, (ns, n) in enumerate(fit, 1)]
    return sorted(found)


def usable(r):
    if r[0] is None or r[1] is None or r[2] is None or any(x is None or not math.isfinite(x) for x in r[1]):
        return False
    return max(map(abs, r[1]), default=0) < 1e6 and sum((256 * x) ** 2 for x in r[1]) < 2**54


def test_products_are_exact_up_to_the_bound():
    rng = np.random.default_rng(1)
    for width, most in ((1, 2**27), (64, 160), (130, 2**22), (700, 3)):
        a, b = rng.integers(-most, most + 1, (9, width)), rng.integers(-most, most + 1, (11, width))
        a[0], b[0], b[1] = most, most, -most
        primes = rns_negatives.primes_for(width * most * most)
        got = rns_negatives.scores(rns_negatives.residues(a, primes), rns_negatives.residues(b, primes), primes)
        assert got.tolist() == (a @ b.T).tolist()


def test_mining_matches_sql_over_the_whole_table(spark):
    got = sorted(map(tuple, queries.op11_rns_negatives(spark, SMALL).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SMALL}/embeddings.parquet'")
    assert got and got == sorted(con.execute(queries.ORACLES["op11_rns_negatives"]).fetchall())


def test_mining_odd_rows_in_small_blocks(spark):
    rng = random.Random(3)
    rows = [(i, [round(rng.gauss(0, 0.3), 2) for _ in range(rng.choice([0, 3, 8, 70]))], rng.randrange(3)) for i in range(90)]
    rows += [(i, [0.5, 0.25, -0.5], i % 2) for i in range(100, 140)]  # ties
    rows += [(200, [0.5], 1), (200, [0.5, 1.0], 1), (300, [], 0)]  # one id, two vectors; an empty vector
    rows += [(None, [1.0], 1), (400, None, 1), (401, [1.0], None), (402, [None, 1.0], 1), (403, [math.nan], 1)]
    rows += [(404, [math.inf], 1), (405, [1e300], 1), (500, [5e5], 1), (501, [4e5], 1), (502, [3e5], 0)]
    rows += rows[:20]  # repeated
    made = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], VECTORS)
    want = plain(rows)
    for block in ((16, 2), (4096, 64)):
        got = rns_negatives.mined(made, block=block)
        assert sorted(map(tuple, got.collect())) == want and len(want) > 30
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_mining_without_rows_or_anchors(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert rns_negatives.mined(empty).count() == 0
    assert rns_negatives.mined(empty.unionByName(spark.createDataFrame([(1, [1.0], 1, "x", 1, 2, 3)], VECTORS))).count() == 0
    alone = spark.createDataFrame([(100, [1.0], 1, "x", 1, 2, 3)], VECTORS)
    assert rns_negatives.mined(alone, F.col("label")).count() == 0
