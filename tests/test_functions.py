import random
from itertools import groupby

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqlake.functions import alignment as al
from seqlake.functions import sequence as sq
from seqlake.functions import text as tf


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


def test_runs_round_trip(spark):
    words = ["AATGGGC", "A", "GGGG", "ACGT", "aacc", ""]
    df = spark.createDataFrame([(w,) for w in words], "s string")
    got = df.select("s", sq.collapse_runs(F.col("s")).alias("c"), sq.run_lengths(F.col("s")).alias("n"), sq.encode_lengths(sq.run_lengths(F.col("s"))).alias("e"))
    got = got.withColumn("d", sq.decode_lengths(F.col("e"))).withColumn("back", sq.expand_runs(F.col("c"), F.col("d"))).collect()
    for r in got:
        runs = [(k, len(list(g))) for k, g in groupby(r["s"].upper())]
        assert r["c"] == "".join(k for k, _ in runs) and r["n"] == [n for _, n in runs] == r["d"]
        assert r["back"] == r["s"].upper()
    assert got[0]["e"] == "2131"


def test_gaps_use_no_count(spark):
    df = spark.createDataFrame([("A-G=", [2, 3])], "s string, n array<int>")
    assert df.select(sq.expand_runs(F.col("s"), F.col("n"))).first()[0] == "AA-GGG-"


def test_long_runs_are_errors(spark):
    with pytest.raises(Exception, match="run length out of range"):
        spark.createDataFrame([([79],)], "n array<int>").select(sq.encode_lengths(F.col("n"))).collect()


def test_reverse_complement(spark):
    assert one(spark, sq.reverse_complement(F.col("s")), s="AACGTN") == "NACGTT"
    assert one(spark, sq.complement(F.col("s")), s="acRY") == "TGYR"
    assert one(spark, sq.reverse_complement(sq.reverse_complement(F.col("s"))), s="MKRYWSBVDHN") == "MKRYWSBVDHN"
    assert one(spark, sq.reverse_lengths(F.col("s")), s="2131") == "1312"
    assert one(spark, sq.looks_like_lengths(F.col("s")), s="2131") and not one(spark, sq.looks_like_lengths(F.col("s")), s="ACG1")


def test_quality_and_ambiguity(spark):
    assert one(spark, sq.mean_phred(F.col("s")), s="!+5") == pytest.approx(10)
    assert one(spark, sq.mean_phred(F.col("s")), s="") is None
    assert one(spark, sq.count_ambiguous(F.col("s")), s="ACNTRa") == 3
    assert one(spark, sq.sequence_key(F.col("s")), s="acgt") == one(spark, sq.sequence_key(F.col("s")), s="ACGT")


def test_between(spark):
    assert one(spark, sq.between(F.col("s"), F.lit(1), F.lit(3)), s="abcde") == "bc"
    assert one(spark, sq.between(F.col("s"), F.lit(2), F.lit(None).cast("int")), s="abcde") == "cde"
    assert one(spark, sq.between(F.col("s"), F.lit(3), F.lit(1)), s="abcde") == ""


def test_sql_functions(spark):
    sq.register(spark)
    r = spark.sql("select seq_collapse_runs('AATGGGC') c, seq_encode_lengths(seq_run_lengths('AATGGGC')) e, seq_decode_lengths('213') d, seq_reverse_complement('AAC') r, seq_count_ambiguous('ANN') n").first()
    assert tuple(r) == ("ATGC", "2131", [2, 1, 3], "GTT", 2)


CASES = [
    ("GATTA-CATA-", "GCTTAACATAG", [(0, "G", "G"), (1, "A", "C"), (2, "TT", "TT"), (4, "A-", "AA"), (5, "C", "C"), (6, "A", "A"), (7, "T", "T"), (8, "A", "A")]),
    ("-CTTAACATAG", "GATT-ACATAG", [(0, "C", "A"), (1, "TT", "TT"), (3, "AA", "-A"), (5, "C", "C"), (6, "A", "A"), (7, "T", "T"), (8, "A", "A"), (9, "G", "G")]),
]


@pytest.mark.parametrize("ref,query,want", CASES)
def test_error_items(ref, query, want):
    assert [(e["i"], e["ref"], e["query"]) for e in al.error_items(ref, query)] == want


def test_error_items_two_gaps():
    with pytest.raises(ValueError):
        al.error_items("A-C", "A-C")


@given(st.text("ACGT", min_size=1, max_size=40))
@settings(max_examples=50, deadline=None)
def test_error_items_of_equal_sequences(s):
    items = al.error_items(s, s)
    assert "".join(e["ref"] for e in items) == s and all(e["ref"] == e["query"] for e in items)


def test_error_category(spark):
    rows = [("A", "A", "equal"), ("A", "-", "indel"), ("A", "C", "snp"), ("AA", "A=", "homoindel"), ("AA", "AC", "compound")]
    df = spark.createDataFrame(rows, "r string, q string, want string").select("want", al.error_category(F.col("r"), F.col("q")).alias("got"))
    assert all(r["want"] == r["got"] for r in df.collect())
    got = spark.createDataFrame([("AC", "AC"), (None, "A")], "r string, q string").select(al.itemize_errors("r", "q").alias("e")).collect()
    assert len(got[0]["e"]) == 2 and got[1]["e"] is None


def test_expanded_pair(spark):
    assert al.expanded_pair("AC-", [2, 1], "A-G", [3, 2]) == ("AA=C--", "AAA-GG")
    df = spark.createDataFrame([("A", [2], "A", [1])], "a string, n array<int>, b string, m array<int>")
    assert tuple(df.select(al.expand_alignment("a", "n", "b", "m").alias("x")).first()["x"]) == ("AA", "A=")


def test_difference(spark):
    r = one(spark, al.shown_difference(F.col("q"), F.col("t")), q="ACRT", t="ATGT")
    assert (r["q"], r["t"]) == (".c..", "AtGT")


def test_gap_before_encoding(spark):
    assert one(spark, sq.without_gap(F.col("s")), s="ACGT") == "ACGT"
    with pytest.raises(Exception, match="gap in a sequence"):
        one(spark, sq.without_gap(F.col("s")), s="AC-T")


def test_coverages(spark):
    r = spark.range(1).select(al.coverage_percent(F.lit(1), F.lit(50), F.lit(100)), al.coverage_open(F.lit(0), F.lit(50), F.lit(100)), al.coverage_fraction(F.lit(1), F.lit(40), F.lit(80))).first()
    assert tuple(r) == (50.0, 0.5, 0.5)


def test_barcodes(spark):
    codes = {"a": "ACGTACGTAC", "b": "TTTTTGGGGG"}
    found = al.barcode_matches(["ACGTACGTACCCCC", "ACGTACGTCCCCCC", "GCGCGCGCGC", "", None], codes, 14)
    assert found[0] == ("a", 0, "exact") and found[2:] == [(None, None, None)] * 3
    rows = spark.createDataFrame([("xxACGTACGTAC",)], "seq string").select(al.match_barcode(codes, 20)("seq").alias("m")).first()["m"]
    assert (rows["sample"], rows["bc_start"], rows["kind"]) == ("a", 2, "exact")


def test_text(spark):
    assert tf.parse_pairs('a:1,b:2.5,"c:x,y"') == {"a": 1, "b": 2.5, "c": "x,y"}
    assert tf.parse_split("col:;:a,b") == ("col", ";", ["a", "b"])
    assert one(spark, tf.safe_name(F.col("s")), s="a:b") == "a_b"
    assert one(spark, tf.newick_name(F.col("s"), "p_"), s=" a:b c ") == "p_a|b_c"
    assert one(spark, tf.is_unclassified(F.col("s")), s="uncultured bacterium") and not one(spark, tf.is_unclassified(F.col("s")), s="Rothia mucilaginosa")
    said = ["Bacillus-like", "marine organism", "putative Vibrio", "Taxon12", "Rothia sp. x", "vector", "strain K12", "str. 5", "Aga"]
    names = spark.createDataFrame([(x,) for x in [*said, "Escherichia coli ATCC 25922", "Uncultured", "vectors", "subgroups"]], "s string")
    assert [r[0] for r in names.where(tf.is_unclassified(F.col("s"))).collect()] == said
    assert {r[0] for r in names.where(tf.is_unclassified(F.col("s"), old=True)).collect()} == set(said) - {"vector", "strain K12", "str. 5"}
    assert one(spark, tf.is_type_strain(F.col("s")), s="x (T) y")
    f = spark.createDataFrame([([("source", {"db_xref": ["x:1", "taxon:123"]})],)], "f array<struct<type:string,qualifiers:map<string,array<string>>>>")
    assert f.select(tf.taxid_of_features(F.col("f"))).first()[0] == "123"


def test_error_counts():
    """Counted in place as the pieces and their categories count; the same pairs are refused."""
    random.seed(5)

    def counted(r, q):
        got = [0] * 7
        for e in al.error_items(r, q):
            a, b = e["ref"], e["query"]
            kind = 0 if a == b else 2 if "-" in a + b else 1 if len(a) == len(b) == 1 else 3 if set(a) - {"="} == set(b) - {"="} else 4
            for i in {0, kind, 5 if kind else 0}:
                got[i] += 1
            got[6] += sum(c not in "-=" for c in a)
        return tuple(got)

    def result(f, *pair):
        try:
            return f(*pair)
        except ValueError as e:
            return str(e)

    for _ in range(4000):
        pair = ["".join(random.choice("AACG-=T") for _ in range(random.randint(0, 14))) for _ in "rq"]
        assert result(al.error_counts, *pair) == result(counted, *pair)
