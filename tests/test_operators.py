import math
import random
from itertools import product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqlake.operators import alignments as ao
from seqlake.operators import clusters as cl
from seqlake.operators import kernels as kn
from seqlake.operators import tables as tb
from seqlake.operators import taxonomy as tx
from seqlake.sources.text_formats import with_order


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_tables(spark):
    a = spark.createDataFrame([("1", "x", "p"), ("2", "", "q")], "k string, v string, w string")
    b = spark.createDataFrame([("1", "y"), ("3", "z")], "k string, v string")
    assert rows(tb.project(a, ["k:id", "w"])) == [("1", "p"), ("2", "q")]
    assert tb.join_tables([a, b], "inner", ["k"]).columns == ["k", "v_x", "w", "v_y"]
    assert tb.join_tables([a, b], "outer", ["k"]).count() == 3
    assert rows(tb.join_tables([a, b.select("v", F.lit("n").alias("n"))], "left").select("k", "n")) == [("1", None), ("2", None)]
    with pytest.raises(ValueError):
        tb.join_tables([a, b.toDF("z", "y")])
    assert tb.concatenate([a, b]).count() == 4 and tb.concatenate([b, b], ["m", "n"]).columns == ["m", "n"]
    assert rows(tb.add_constants(b, {"v": 1})) == [("1", 1), ("3", 1)]
    assert tb.rename(b, {"k": "key"}).columns == ["key", "v"]
    assert rows(tb.two_columns(a)) == [("", "q"), ("x", "p")]
    assert rows(tb.two_columns(a, "0")) == [("1", "1"), ("2", "2")]


def test_split_column(spark):
    df = spark.createDataFrame([("a| b", 1), ("c", 2)], "s string, n int")
    out = tb.split_column(df, "s", "|", ["x", "y"])
    assert out.columns == ["s", "x", "y", "n"] and rows(out) == [("a| b", "a", "b", 1), ("c", "", "", 2)]
    assert df.select(tb.replace_text(F.col("s"), [("|", "."), (".", "-")]).alias("r")).first()["r"] == "a- b"


def test_deduplicate(spark):
    df = spark.createDataFrame([(1, "a", 2), (2, "a", 1), (3, "b", 1)], "id int, g string, o int")
    assert rows(tb.deduplicate(df, ["g"], ["o"])) == [(2, "a", 1), (3, "b", 1)]
    assert rows(tb.deduplicate(df, ["g"], ["o"], last=True)) == [(1, "a", 2), (3, "b", 1)]
    assert tb.deduplicate(df.select("g")).count() == 2 and tb.deduplicate(df, ["g"]).count() == 2


def test_ranked(spark):
    df = spark.createDataFrame([("q", 0), ("q", 0), ("q", 2), ("q", 3), ("q", None)], "q string, m int")
    assert rows(tb.best_ranked(df, ["q"], "m", 3)) == [("q", 0), ("q", 0), ("q", 2)]
    parts = tb.chunks(spark.range(105).select(F.col("id"), F.lit(1).alias("g")), 25, ["g"]).groupBy("chunk").count()
    assert rows(parts.select("count")) == [(25,), (25,), (25,), (30,)]


def test_dedup_sequences(spark):
    df = with_order(spark.createDataFrame([(1, "ACGT", "x", ""), (2, "acgt", "x", ""), (3, "ACGT", "", "y"), (4, "GG", "x", "")], "id int, seq string, g string, f string"), "id")
    kept, mapped, weights = cl.dedup_sequences(df, ["g"], ["f"])
    assert rows(kept.select("id")) == [(1,), (3,), (4,)]
    assert rows(mapped) == [(1, 1), (1, 2), (3, 3), (4, 4)] and rows(weights) == [(1, 2), (3, 1), (4, 1)]


def test_clusters(spark):
    uc = spark.createDataFrame([("S", None, "a", None), ("H", None, "b", "a"), ("H", None, "c", "a"), ("S", None, "d", None), ("C", 3, "a", None), ("C", 1, "d", None)], "type string, size int, query_label string, target_label string")
    reads, spec, weights = cl.map_clusters(uc, least=2)
    assert rows(reads) == [("a", "a"), ("b", "a"), ("c", "a")] and rows(weights) == [("a", 3.0)] and spec.count() == 3
    assert rows(cl.cluster_sizes(uc)) == [("a", 3), ("d", 1)]
    groups = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "y"), ("d", "x")], "read string, group string")
    assert rows(cl.map_clusters(uc, groups=groups)[2]) == [("a", 3.0), ("d", 1.0)]


def test_consensus(spark):
    df = spark.createDataFrame([("c", "AC-T"), ("c", "AG-T"), ("c", "ACAT"), ("d", "NN")], "g string, seq string")
    assert rows(cl.consensus(df, ["g"])) == [("c", "ACT"), ("d", "NN")]
    assert dict(rows(cl.consensus(df, ["g"], keep_gaps=True)))["c"] == "AC-T"
    runs = spark.createDataFrame([("c", 0, 2), ("c", 0, 3), ("c", 1, 4), ("c", 1, 4), ("c", 1, None)], "g string, pos int, len int")
    assert rows(cl.consensus_lengths(runs, ["g"])) == [("c", 0, 2), ("c", 1, 4)]


def test_denoise_keeps_all_reads(spark):
    seqs = spark.createDataFrame([("a", "ACGTACGT"), ("b", "ACGTACGT"), ("c", "ACGACGT"), ("d", "TTTTTTTT"), ("e", "acgtacgt")], "id string, seq string")
    clusters = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "a"), ("d", "d")], "read string, cluster string")
    got = cl.denoise(seqs, clusters).collect()
    assert sum(r["weight"] for r in got) == 5
    assert {r["consensus"]: r["weight"] for r in got} == {"ACGTACGT": 4.0, "TTTTTTTT": 1.0}
    assert sorted(r["name"] for r in got) == ["cons0001_4", "cons0002_1"]


def brute(a, b):
    """Global affine score, one gap state each, by plain recursion tables."""
    low = -(10**8)
    n, m = len(a), len(b)
    M = [[low] * (m + 1) for _ in range(n + 1)]
    X, Y = [r[:] for r in M], [r[:] for r in M]
    M[0][0] = 0
    for i, j in product(range(n + 1), range(m + 1)):
        if i and j:
            M[i][j] = max(M[i - 1][j - 1], X[i - 1][j - 1], Y[i - 1][j - 1]) + (kn.MATCH if a[i - 1] == b[j - 1] else kn.MISMATCH)
        if i:
            X[i][j] = max(M[i - 1][j] + kn.OPEN, X[i - 1][j] + kn.EXTEND, Y[i - 1][j] + kn.OPEN)
        if j:
            Y[i][j] = max(M[i][j - 1] + kn.OPEN, Y[i][j - 1] + kn.EXTEND, X[i][j - 1] + kn.OPEN)
    return max(M[n][m], X[n][m], Y[n][m])


@given(st.text("ACG", min_size=1, max_size=9), st.text("ACG", min_size=1, max_size=9))
@settings(max_examples=80, deadline=None)
def test_global_alignment(a, b):
    score, x, y, _, _ = kn.aligned(a, b, local=False)
    assert score == brute(a, b) and x.replace("-", "") == a and y.replace("-", "") == b and len(x) == len(y)


def test_kmer_candidates_of_crowded_words(spark):
    """Words in more targets than `frequent` still make pairs, each with its number of common words."""
    q = spark.createDataFrame([("a", "ACGTACC"), ("b", "GGGGGGG"), ("c", "TTT")], "id string, seq string")
    t = spark.createDataFrame([(f"t{i}", "ACGTACC" if i % 2 else "ACGTAGG") for i in range(40)] + [("u", "GGGGGC")], "id string, seq string")
    want = {("a", f"t{i}"): 4 if i % 2 else 2 for i in range(40)} | {("b", "u"): 1}
    for frequent in (3, 10_000):
        got = kn.kmer_candidates(q, t, k=4, frequent=frequent).collect()
        assert len(got) == len(want) and {(r["q_id"], r["t_id"]): r["words"] for r in got} == want


def test_search(spark):
    target = "ACGTTGCAACGGTTACCATGGACTTGACCA"
    q = spark.createDataFrame([("q", target[5:25]), ("none", "T" * 20)], "id string, seq string")
    t = spark.createDataFrame([("t", target), ("u", "G" * 30)], "id string, seq string")
    r = kn.search(q, t, identity=0.9).collect()
    assert [(x["q_id"], x["t_id"], x["ident"], x["t_start"], x["t_end"]) for x in r] == [("q", "t", 1.0, 6, 25)]
    seqs = spark.createDataFrame([(str(i), "ACGT"[: i + 1], i) for i in range(4)], "id string, seq string, place int")
    assert kn.all_pairs(seqs).count() == 6
    assert cl.align_star(["ACGT", "AGT", "ACGGT"])[1].replace("-", "") == "AGT"


def spec_condense(lineage, most):
    """The rule as a recursion, for comparison."""
    depth = len(next(iter(lineage.values())))

    def go(ids, r, budget, above):
        if r == depth:
            return {i: above or i for i in ids}
        parts = {}
        for i in ids:
            parts.setdefault(lineage[i][r] or above or i, set()).add(i)
        if above is not None and len(parts) > budget:
            return {i: above for i in ids}
        out = {}
        for k, m in parts.items():
            out |= go(m, r + 1, budget - len(parts) + 1, k)
        return out

    return go(set(lineage), 0, most, None)


def test_condense():
    random.seed(3)
    for _ in range(300):
        ids = {}
        for i in range(random.randint(1, 8)):
            f, g = random.randint(0, 1), random.randint(0, 2)
            ids[f"s{i}"] = ["1", f"f{f}", None if random.random() < 0.2 else f"g{f}{g}", f"s{i}"]
        most = random.randint(1, 4)
        got = tx.condense(ids, most)
        assert got == spec_condense(ids, most)
    assert tx.condense({"a": ["1", "a"], "b": ["1", "b"]}, 5, [None, 1]) == {"a": "1", "b": "1"}


def test_assignment_text(spark):
    df = spark.createDataFrame([("k", "Streptococcus mutans", True), ("k", "Streptococcus mutans", False), ("k", "Streptococcus infantarius", False), ("k", "Rhizobiales", False)], "k string, name string, starred boolean")
    assert rows(tx.assignment_text(df, ["k"])) == [("k", "Rhizobiales;Streptococcus infantarius/mutans*")]


def test_best_rank(spark):
    df = spark.createDataFrame([("k", "genus"), ("k", "species"), ("k", None)], "k string, rank string")
    assert rows(tx.best_rank(df, ["k"], ["root", "genus", "species"])) == [("k", "species")]


def taxa(spark):
    return spark.createDataFrame([("1", "1", "root", "root", "1", None, None), ("g", "1", "genus", "G", "1", "g", None), ("a", "g", "species", "G a", "1", "g", "a"), ("b", "g", "species", "G b", "1", "g", "b")], "tax_id string, parent_id string, rank string, tax_name string, root string, genus string, species string")


def test_thresholds(spark):
    t = taxa(spark)
    ranks = tx.rank_columns(t)
    assert ranks == ["root", "genus", "species"]
    wide = spark.createDataFrame([("1", 80.0, 90.0, 97.0), ("a", 80.0, 91.0, 98.0)], "tax_id string, root double, genus double, species double")
    got = dict(rows(tx.resolved_thresholds(tx.lineages(t, ranks), tx.threshold_arrays(wide, ranks))))
    assert got["a"] == [80.0, 91.0, 98.0] and got["b"] == [80.0, 90.0, 97.0]
    long = spark.createDataFrame([("1", 80.0, "root"), ("g", 91.0, "species")], "tax_id string, low double, target_rank string")
    assert dict((r[0], r[1:]) for r in rows(tx.thresholds_of_taxa(t, long, ranks)))["a"] == (80.0, 80.0, 91.0)
    with pytest.raises(ValueError):
        tx.threshold_arrays(wide.drop("genus"), ranks)
    kids = tx.children(t, ["g"], ranks)
    assert [r["tax_id"] for r in kids.collect()] == ["g", "a", "b"]
    with pytest.raises(Exception, match="more than one"):
        tx.children(t, ["g", "1"], ranks).collect()


def test_alignment_tables(spark):
    al = spark.createDataFrame([("q1", "t", "ACCGT", "AACGT", 1, 5, 5, 50.0, "f"), ("q1", "t", "ACCGT", "AACGT", 2, 5, 5, 40.0, "f"), ("q2", "t", "A-CGT", "AACGT", 1, 5, 5, 10.0, "r")], "q_name string, t_name string, q_seq string, t_seq string, q_al_start int, q_al_stop int, t_sq_len int, sw_zscore double, sw_frame string")
    al = al.withColumn("t_al_start", F.lit(1)).withColumn("t_al_stop", F.lit(5)).withColumn("_ord", F.monotonically_increasing_id())
    assert ao.top_hits(al).count() == 2 and ao.above_score(al, 20).count() == 2 and ao.above_score(al, None).count() == 3
    assert rows(ao.positions(al, "left", False).select("name", "position"))[0] == ("q1", 5)
    assert rows(ao.positions(al, "right", True, where="sw_zscore > 20")) == [("q1", 5)]
    info = spark.createDataFrame([("q1", "s1", ""), ("q2", "s2", "g")], "seqname string, species string, genus string")
    comp = ao.base_composition(al, info, "genus", full_length=True)
    first = comp.where("rank_id = 's1' and pos = 1").first()
    assert (first["expected"], first["C"], first["naligns"], first["nseqs"]) == ("A", 1, 1, 2)
    tally = {r["q_name"]: r for r in ao.error_tallies(ao.top_hits(al)).collect()}
    assert tally["q2"]["indel"] == 1 and tally["q1"]["total"] >= 1
    assert ao.with_difference(ao.top_hits(al)).where("q_name = 'q1'").first()["q_diff"].startswith(".c")


def test_differences_without_outer_gaps(spark):
    al = spark.createDataFrame([("q", "--ACGT", "--ACTT", 1, 4, 1, 4)], "q_name string, q_seq string, t_seq string, q_al_start int, q_al_stop int, t_al_start int, t_al_stop int")
    r = ao.with_difference(al).first()
    assert (r["q_diff"], r["t_diff"]) == ("..g.", "ACtT")


def test_run_transitions(spark):
    pieces = [("A", "A"), ("A", "T"), ("-", "A"), ("AA=", "AAA"), ("C", "-"), ("GG", "G="), ("A-A", "AAA"), ("TTTTTTT", "TTTTTTT"), ("A", "AC")]
    errors = spark.createDataFrame([("q", "t", i, r, q, "") for i, (r, q) in enumerate(pieces)], "q_name string, t_name string, i int, ref string, query string, category string")
    got = {(r["base"], r["ref_length"]): {k: v for k, v in r.asDict().items() if k not in ("base", "ref_length") and v} for r in ao.run_transitions(errors).collect()}
    assert got == {
        ("A", "0"): {"1": 1}, ("A", "1"): {"1": 1}, ("A", "2"): {"3": 1}, ("C", "1"): {"0": 1}, ("G", "2"): {"1": 1}, ("T", "geq6"): {"geq6": 1},
        ("total", "0"): {"1": 1}, ("total", "1"): {"0": 1, "1": 1}, ("total", "2"): {"1": 1, "3": 1}, ("total", "geq6"): {"geq6": 1},
    }


def test_positions_of_first_hits_only(spark):
    al = spark.createDataFrame([("a", 9, 12, 50.0, 0), ("a", 2, 5, 40.0, 1), ("b", 3, 6, 30.0, 2)], "q_name string, q_al_start int, q_al_stop int, sw_zscore double, _ord int")
    assert rows(ao.positions(al, "left", False, most=5)) == [("b", 6)]
    assert rows(ao.positions(al, "left", False, score=35.0)) == [("a", 12)]


def test_trim_and_pull(spark):
    seqs = spark.createDataFrame([("a", "xACGTy", "d1"), ("b", "ACGT", "d2")], "id string, seq string, description string")
    left = spark.createDataFrame([("a", 1)], "name string, position int")
    right = spark.createDataFrame([("a", 5), ("b", 2)], "name string, position int")
    assert rows(ao.trim_primers(seqs, left, right).select("id", "seq")) == [("a", "ACGT")]
    assert rows(ao.trim_primers(seqs, left, right, keep_all=True).select("id", "seq")) == [("a", "ACGT"), ("b", "AC")]
    m = spark.createDataFrame([("d1", "s"), ("d2", "u")], "sequence_id string, sample string")
    assert [r["id"] for r in ao.pull_reads(seqs, m, "s").collect()] == ["a"]


def test_medians_and_barcodes(spark):
    pairs = spark.createDataFrame([("a", "b", 0.801), ("a", "c", 0.5)], "a string, b string, score double")
    m = ao.pair_medians(pairs)
    assert ("b", "a", 0.81) in rows(m)
    matrix = ao.distance_matrix(m, ["a", "b", "c"])
    assert {r["a"]: r["c"] for r in matrix.collect()}["b"] == 0
    reads = spark.createDataFrame([("1", "ACGTACGTACAAAA"), ("2", "GCGCGCGCGCGCGC"), ("3", "AC")], "id string, seq string")
    found, counts = ao.split_barcodes(reads, {"s": "ACGTACGTAC"}, 12, least=5)
    assert dict(rows(counts)) == {"s": 1, "no_match": 1, "total_matched": 1, "fail_len": 1} and found.count() == 2


def test_tree(spark):
    t = spark.createDataFrame([("(a b:1,c:2);",)], "tree string")
    assert ao.edit_tree(t, prefix="x").first()["tree"] == "(xa_b:1,xc:2);"
    assert ao.edit_tree(t, {"c": "new"}).first()["tree"] == "(a b:1,new:2);"
    assert math.isclose(spark.range(1).select(ao.distance(F.lit(0.25))).first()[0], 0.75)


def test_pairs_aligned_together(monkeypatch):
    """Pairs that are filled in one table have the alignments they have alone; few tables are filled."""
    random.seed(3)
    pairs = [("".join(random.choice("ACGTN") for _ in range(random.randint(0, 24))), "".join(random.choice("ACGT") for _ in range(random.randint(0, 24)))) for _ in range(200)]
    for local in (True, False):
        alone = [kn.aligned(a, b, local) for a, b in pairs]
        filled, calls = kn._filled, []
        monkeypatch.setattr(kn, "_filled", lambda some, *rest: calls.append(len(some)) or filled(some, *rest))  # noqa: B023
        assert kn.aligned_all(pairs, local) == alone and len(calls) == 1
        monkeypatch.setattr(kn, "CELLS", 5000)
        assert kn.aligned_all(pairs, local) == alone and 10 < len(calls) < 100
        monkeypatch.undo()
