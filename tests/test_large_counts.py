"""Exact counts beyond 64 bits against Python's whole numbers."""

import itertools
import random
from math import comb, prod

import pytest
from pyspark.sql import functions as F

from lexgrove.functions import residues
from lexgrove.operators import audits, constraint, probe


def sets_of(counts, k, b):
    """Sum over k-subsets of C(sum of the subset, b), subset by subset."""
    return sum(comb(sum(s), b) for s in itertools.combinations(counts, k))


def of_children(spark, counts):
    """A graph of which only children matter: a node for each list, whose children have so many children of their own."""
    rows = [("wordnet", p, f"{p}/{i}") for p, own in counts.items() for i in range(len(own))]
    rows += [("wordnet", f"{p}/{i}", f"{p}/{i}/{j}") for p, own in counts.items() for i, n in enumerate(own) for j in range(n)]
    children = spark.createDataFrame(rows, "family string, parent string, child string")
    return constraint.Graph(None, None, None, None, children, None)


def test_primes_reach_the_bound():
    got = residues.primes(300)
    assert len(set(got)) == len(got) == 10 and prod(got) > 2**300 and got[0] == 2**31 - 1
    assert len(residues.primes(0)) == 1
    with pytest.raises(ValueError):
        residues.primes(2000)


def test_text_out_of_residues(spark):
    r = random.Random(4)
    moduli = residues.primes(250)
    values = [0, 1, 10**8, 10**8 - 1, 2**63, 10**40, 10**72 + 10**8, prod(moduli) - 1, *(r.randrange(2 ** r.randrange(1, 250)) for _ in range(60))]
    rows = spark.createDataFrame([(i, [v % q for q in moduli], "kept") for i, v in enumerate(values)], "i int, r array<long>, digit string")
    got = residues.text_of(F.col("r"), moduli, rows, "n")
    assert got.columns == ["i", "r", "digit", "n"]
    assert {x["i"]: x["n"] for x in got.collect()} == {i: str(v) for i, v in enumerate(values)}


def test_sums_of_texts(spark):
    r = random.Random(5)
    rows = [(r.choice("ab"), str(r.randrange(10 ** r.randrange(1, 60)))) for _ in range(300)] + [("a", None), ("c", None), ("d", "0"), (None, "9" * 40), (None, "1")]
    got = {x["k"]: x["n"] for x in residues.sum_texts(spark.createDataFrame(rows, "k string, t string"), ["k"], "t", "n").collect()}
    assert got == {k: str(sum(int(t) for g, t in rows if g == k and t)) for k in ("a", "b", "d", None)}


def test_structural_counts_against_subsets(spark):
    r = random.Random(7)
    counts = {f"p{i}": [r.randrange(7) for _ in range(r.randrange(1, 9))] for i in range(12)} | {"alike": [3] * 9, "bare": [0, 0, 0], "one": [5]}
    got = {(x["a1"], x["a_count"], x["b_count"]): (x["branch_sets"], x["n"]) for x in audits.structural_counts(of_children(spark, counts)).collect()}
    for p, own in counts.items():
        for a in range(1, 6):
            for b in range(6):
                n = comb(len(own), b) if a == 1 else sets_of(own, a - 1, b)
                assert got[p, a, b] == (str(comb(len(own), a - 1)), str(n)), (p, a, b)
    none = constraint.Graph(None, None, None, None, of_children(spark, counts).children.limit(0), None)
    assert audits.structural_counts(none).count() == 0


def test_structural_counts_of_wide_nodes(spark):
    """Six hundred branches of a hundred options: numbers of 69 bits, which one sum over equal branches tells."""
    got = {(x["a1"], x["a_count"], x["b_count"]): int(x["n"]) for x in audits.structural_counts(of_children(spark, {"wide": [100] * 600})).where("a1 = 'wide'").collect()}
    assert all(got["wide", a, b] == comb(600, a - 1) * comb(100 * (a - 1), b) for a in range(2, 6) for b in range(6))
    assert got["wide", 5, 5] > 2**63


def test_probe_summary_beyond_38_digits(spark):
    """The sum over heads is exact where decimals end."""
    structural = spark.createDataFrame([("wordnet", f"h{i}", 5, 5, str(10**40 + i)) for i in range(50)], "family string, a1 string, a_count int, b_count int, n string")
    cores = spark.createDataFrame([("wordnet", 5, 5, 2, 3), ("wordnet", 5, 5, 0, 9)], "family string, a_count int, b_count int, positive int, negative int")
    got = {(x["a_count"], x["b_count"]): x for x in probe.probe_summary(cores, structural).collect()}
    assert got[5, 5]["constraints"] == str(50 * 10**40 + 1225) and got[5, 5]["status"] == "available" and got[5, 5]["heads"] == 50
    assert len(got) == 30 and got[1, 0]["constraints"] == "0" and got[1, 0]["status"] == "infeasible"
