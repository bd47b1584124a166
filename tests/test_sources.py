import gzip
import json

from pyspark.sql import functions as F

from seqlake.operators.alignments import record_info, record_sequences
from seqlake.sources import records, sinks
from seqlake.sources import text_formats as tx


def put(tmp_path, name, text):
    p = tmp_path / name
    (gzip.open(p, "wt") if name.endswith(".gz") else p.open("w")).write(text)
    return str(p)


def test_fasta(spark, tmp_path):
    p = put(tmp_path, "a.fasta", ">H1 one|1\nACGT\nacg\n>H2\n\n>H3 x\nTT\n")
    rows = tx.read_fasta(spark, p).orderBy("_ord").collect()
    assert [(r["id"], r["description"], r["seq"]) for r in rows] == [("H1", "H1 one|1", "ACGTacg"), ("H2", "H2", ""), ("H3", "H3 x", "TT")]
    assert tx.read_fasta(spark, p, limit=1).count() == 1
    p = put(tmp_path, "end.fasta", ">a\n>b\nAC\n>c\n")
    assert [r["id"] for r in tx.read_fasta(spark, p).orderBy("_ord").collect()] == ["a", "b"]
    assert [r["id"] for r in tx.read_fasta(spark, p, drop_last_empty=False).orderBy("_ord").collect()] == ["a", "b", "c"]


def test_fasta_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a 1", "ACGT", "x"), ("b", "GG", "y")], "description string, seq string, specimen string")
    sinks.write_fasta(df, str(tmp_path / "out"), by="specimen", compression="gzip")
    back = tx.read_fasta(spark, [str(tmp_path / "out" / f"specimen={s}") for s in "xy"])
    assert {(r["description"], r["seq"]) for r in back.collect()} == {("a 1", "ACGT"), ("b", "GG")}


def test_fastq(spark, tmp_path):
    p = put(tmp_path, "a.fastq", "@r:1 x\nACGT\n+\n@III\n@r2\nAC\n+r2\nII\n")
    rows = tx.read_fastq(spark, p).orderBy("_ord").collect()
    assert [(r["name"], r["seq"], r["qual"]) for r in rows] == [("r:1", "ACGT", "@III"), ("r2", "AC", "II")]


def test_tables(spark, tmp_path):
    p = put(tmp_path, "a.csv.gz", "a,b\n1,x\n2,\"y,z\"\n")
    assert [tuple(r)[:2] for r in tx.read_table(spark, p).orderBy("a").collect()] == [("1", "x"), ("2", "y,z")]
    p = put(tmp_path, "b.csv", "1,x\n2,y\n1,z\n")
    df = tx.read_table(spark, p, header=False)
    assert df.columns[:2] == ["_c0", "_c1"]
    last = tx.read_lookup(df.withColumnsRenamed({"_c0": "k", "_c1": "v"}), "k", "v")
    assert {tuple(r) for r in last.collect()} == {("1", "z"), ("2", "y")}
    p = put(tmp_path, "bar.csv", "sample,barcode\na,ACG\n")
    assert tx.read_barcodes(spark, p).first()["barcode"] == "ACG"


def test_blast_and_clusters(spark, tmp_path):
    p = put(tmp_path, "h.csv", "q1,s1,99.5,1,100,100,100\nq2,s2,97,1,50,100,50\n")
    assert [r["pident"] for r in tx.read_blast(spark, p).orderBy("qseqid").collect()] == [99.5, 97.0]
    p = put(tmp_path, "c.uc", "S\t0\t10\t*\t*\t*\t*\t*\ta\t*\nH\t0\t10\t99.0\t+\t0\t0\t=\tb\ta\nC\t0\t2\t*\t*\t*\t*\t*\ta\t*\n")
    rows = tx.read_clusters(spark, p).collect()
    assert [r["type"] for r in rows] == ["S", "H", "C"] and rows[0]["target_label"] is None and rows[1]["target_label"] == "a"


def test_scores(spark, tmp_path):
    p = put(tmp_path, "s.scores", "# head\n# more\n  1  seqA  10  5.5  1.0  0.99  00:00\n  2  seqB  12  6.5  2.0  0.98  00:00\n#\n# tail\n  3  no  1 1 1 1\n")
    assert [(r["name"], r["len"], r["total"]) for r in tx.read_scores(spark, p).orderBy("name").collect()] == [("seqA", 10, 5.5), ("seqB", 12, 6.5)]


REPORT = """# search
>>>q1, 10 nt vs library
; pg_name: x
>>t1 some
; sw_zscore: 120.5
; sw_ident: 0.9
>q1 ..
; sq_len: 10
; al_start: 1
ACGT
AC
>t1 ..
; sq_len: 12
ACG-TT
>>t2 other
; sw_zscore: 80
>q1 ..
AC
>t2 ..
AG
>>><<<
"""


def test_alignments(spark, tmp_path):
    rows = tx.read_alignments(spark, put(tmp_path, "r.txt", REPORT)).orderBy("_ord").collect()
    assert [(r["q_name"], r["t_name"], r["q_seq"], r["t_seq"]) for r in rows] == [("q1", "t1", "ACGTAC", "ACG-TT"), ("q1", "t2", "AC", "AG")]
    assert rows[0]["fields"]["sw_zscore"] == "120.5" and rows[0]["fields"]["q_sq_len"] == "10" and rows[0]["fields"]["t_sq_len"] == "12"


FLAT = """LOCUS       AB1  12 bp
DEFINITION  Some species strain (T).
VERSION     AB1.1
FEATURES             Location/Qualifiers
     source          1..12
                     /db_xref="taxon:77"
     rRNA            complement(3..8)
                     /product="16S"
                     /locus_tag="L1"
ORIGIN
        1 aacgtn gtcatt
//
LOCUS       AB2  4 bp
DEFINITION  Other.
VERSION     AB2.1
ORIGIN
        1 acgt
//
"""


def test_flat_files(spark, tmp_path):
    df = tx.read_genbank(spark, put(tmp_path, "a.gb", FLAT))
    rows = {r["name"]: r for r in df.collect()}
    assert set(rows) == {"AB1", "AB2"} and rows["AB1"]["seq"] == "AACGTNGTCATT" and rows["AB1"]["features"][1]["strand"] == -1
    cut = record_sequences(df, feature="rRNA", product=["16S"]).collect()
    assert [(r["id"], r["seq"]) for r in cut] == [("AB1_L1", "ACNACG")]
    assert tuple(record_sequences(df, region=(1, 4)).orderBy("id").select("id", "seq").first()) == ("AB1_1_4", "ACG")
    whole = {r["id"]: r["seq"] for r in record_sequences(df, minus=True).collect()}
    assert whole == {"AB1": "AATGACNACGTT", "AB2": "ACGT"}  # only AB1 has a source feature
    facts = {r["seqname"]: (r["tax_id"], r["accession"], r["length"], r["ambig_count"]) for r in record_info(record_sequences(df)).collect()}
    assert facts["AB1"] == ("77", "AB1.1", 12, 1) and facts["AB2"][0] is None
    assert record_sequences(df, types_only=True).count() == 1 and record_sequences(df, least=5).count() == 1
    got = records.fetch_records(spark.createDataFrame([("AB1", None, None), ("no", None, None)], "id string, seq_start string, seq_stop string"), lambda i, a, b: FLAT.split("//")[0] if i == "AB1" else None).collect()
    assert [(r["seqid"], r["tax_id"]) for r in got] == [("AB1.1", "77")]


def test_trees_and_json(spark, tmp_path):
    assert [r["tree"] for r in tx.read_newick(spark, put(tmp_path, "a.nwk", "(a:1,b:2)\n;\n(c,d);\n")).collect()] == ["(a:1,b:2);", "(c,d);"]
    p = put(tmp_path, "r.json", json.dumps({"a": "21", "b": "3"}))
    assert {tuple(r) for r in tx.read_run_lengths(spark, p).collect()} == {("a", "21"), ("b", "3")}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.005), ("b", 2.0)], "k string, v double")
    sinks.write_table(df.coalesce(1), str(tmp_path / "t"), decimals=2, quote_all=True)
    text = "".join(p.read_text() for p in (tmp_path / "t").glob("part-*"))
    assert '"k","v"' in text and '"b","2.00"' in text
    sinks.write_indexed(df, str(tmp_path / "i"), ["k"])
    assert spark.read.parquet(str(tmp_path / "i")).count() == 2
    d = sinks.length_density(df.select(F.lit(5).alias("n")), "n", [5.0, 50.0]).orderBy("value").collect()
    assert d[0]["density"] > 0.39 and d[1]["density"] < 1e-9
