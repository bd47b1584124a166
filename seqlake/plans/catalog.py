"""Queries over the driver's tables: every operator once, most with the same query as DuckDB SQL.

The tables are read as sequence data: suppliers, nations and regions are a taxonomy, line items are search hits of orders,
customers' numbers are specimens, names of parts are sequences, events of a user are a cluster of reads.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlake.functions import alignment as al
from seqlake.functions import sequence as sq
from seqlake.functions import text as tf
from seqlake.operators import alignments as ao
from seqlake.operators import clusters as cl
from seqlake.operators import kernels as kn
from seqlake.operators import tables as tb
from seqlake.operators import taxonomy as tx
from seqlake.plans import classifier as cf
from seqlake.sources import sinks
from seqlake.sources.text_formats import first_position, read_lookup, with_order

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
RANKS = ["root", "family", "genus", "species"]


def query(sql: str | None = None):
    """Register a query by its function's name, with its SQL."""

    def of(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return of


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- the tables as sequence data ------------------------------------------------------------------------------------


def taxonomy(spark, d) -> DataFrame:
    none = F.lit(None).cast("string")
    rid, nid, sid = F.concat(F.lit("r"), "r_regionkey"), F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("s"), "s_suppkey")
    region, nation, supplier = t(spark, d, "region"), t(spark, d, "nation"), t(spark, d, "supplier")
    placed = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    root = spark.range(1).select(F.lit("1").alias("tax_id"), none.alias("parent_id"), F.lit("root").alias("rank"), F.lit("root").alias("tax_name"), F.lit("1").alias("root"), none.alias("family"), none.alias("genus"), none.alias("species"))
    families = region.select(rid, F.lit("1"), F.lit("family"), "r_name", F.lit("1"), rid, none, none)
    genera = placed.select(nid, rid, F.lit("genus"), "n_name", F.lit("1"), rid, nid, none)
    species = supplier.join(placed, F.col("s_nationkey") == F.col("n_nationkey")).select(sid, nid, F.lit("species"), F.concat("n_name", F.lit(" s"), "s_suppkey"), F.lit("1"), rid, nid, sid)
    return root.union(families).union(genera).union(species)


def hits(spark, d) -> DataFrame:
    line = t(spark, d, "lineitem")
    pident = ((F.col("l_partkey") * 31 + F.col("l_suppkey") * 17) % 1200) / F.lit(100.0) + 88
    return line.select(
        F.concat(F.lit("q"), "l_orderkey").alias("qseqid"),
        F.when(F.col("l_linenumber") < 7, F.concat(F.lit("s"), "l_suppkey")).alias("sseqid"),
        pident.alias("pident"),
        F.lit(1).alias("qstart"),
        (F.col("l_quantity").cast("int") + 50).alias("qend"),
        F.lit(100).alias("qlen"),
        (F.col("l_quantity").cast("int") + 50).cast("double").alias("qcovs"),
        F.col("l_linenumber").cast("int").alias("mismatch"),
    )


def seq_info(spark, d) -> DataFrame:
    s = t(spark, d, "supplier")
    tax = F.when(F.col("s_suppkey") % 10 == 0, F.concat(F.lit("n"), "s_nationkey")).otherwise(F.concat(F.lit("s"), "s_suppkey"))
    return s.select(F.concat(F.lit("s"), "s_suppkey").alias("seqname"), tax.alias("tax_id"), F.concat(F.lit("A"), "s_suppkey").alias("accession"), (F.col("s_suppkey") % 4).cast("int").alias("ambig_count"))


def thresholds(spark) -> DataFrame:
    return spark.createDataFrame([("1", 85.0, 90.0, 94.0, 97.0), ("r1", 85.0, 91.0, 95.0, 98.0)], "tax_id string, root double, family double, genus double, species double")


def specimens(spark, d) -> DataFrame:
    o = t(spark, d, "orders")
    return o.select(F.concat(F.lit("q"), "o_orderkey").alias("qseqid"), F.concat(F.lit("sp"), (F.col("o_custkey") % 25)).alias("specimen"))


SQL_BASE = """
with tax as (
    select '1' tax_id, null parent_id, 'root' "rank", 'root' tax_name, '1' root, null family, null genus, null species
    union all select 'r' || r_regionkey, '1', 'family', r_name, '1', 'r' || r_regionkey, null, null from region
    union all select 'n' || n_nationkey, 'r' || n_regionkey, 'genus', n_name, '1', 'r' || n_regionkey, 'n' || n_nationkey, null from nation
    union all select 's' || s_suppkey, 'n' || n_nationkey, 'species', n_name || ' s' || s_suppkey, '1', 'r' || n_regionkey, 'n' || n_nationkey, 's' || s_suppkey from supplier join nation on s_nationkey = n_nationkey
), hits as (
    select 'q' || l_orderkey qseqid, case when l_linenumber < 7 then 's' || l_suppkey end sseqid, ((l_partkey * 31 + l_suppkey * 17) % 1200) / 100.0::double + 88 pident, l_quantity::int + 50 qcov, l_linenumber::int mismatch from lineitem
), info as (
    select 's' || s_suppkey seqname, case when s_suppkey % 10 = 0 then 'n' || s_nationkey else 's' || s_suppkey end tax_id from supplier
), lin as (
    select tax_id, tax_name, "rank", [root, family, genus, species] lineage,
        case when family = 'r1' then [85.0, 91.0, 95.0, 98.0]::double[] else [85.0, 90.0, 94.0, 97.0]::double[] end thr from tax
), spec as (select distinct 'q' || o_orderkey qseqid, 'sp' || (o_custkey % 25) specimen from orders
), j as (
    select h.*, specimen, lin.*, row_number() over () id from hits h join spec using (qseqid) join info on seqname = sseqid join lin on lin.tax_id = info.tax_id
), deep as (
    select *, list_max([case when pident > thr[i] and lineage[i] is not null then i else 0 end for i in [1, 2, 3, 4]]) dp from j
), ranked as (
    select *, max(dp) over (partition by specimen, qseqid) r from deep
), passed as (
    select *, list_max([case when lineage[i] is not null and i <= r then i else 0 end for i in [1, 2, 3, 4]]) lvl from ranked where r > 0 and pident > thr[r]
), whole as (select *, lineage[lvl] assignment_tax_id, thr[r] assignment_threshold from passed where lvl = r
), used as (select distinct specimen, qseqid, i, lineage[i] a from whole, (select unnest([1, 2, 3, 4]) i) where lineage[i] is not null
), valid as (
    select * from whole union all
    select *, lineage[lvl], thr[r] from passed where lvl < r and lvl > 0 and not exists (select 1 from used u where u.specimen = passed.specimen and u.qseqid = passed.qseqid and u.i = lvl and u.a = lineage[lvl])
)
"""


def valid_hits(spark, d) -> DataFrame:
    tax = taxonomy(spark, d)
    lineage = tx.lineages(tax, RANKS)
    taxa = lineage.join(tx.resolved_thresholds(lineage, tx.threshold_arrays(thresholds(spark), RANKS)), "tax_id")
    named = cf.with_specimens(hits(spark, d), specimens(spark, d)).where("sseqid is not null")
    references = seq_info(spark, d).withColumnRenamed("seqname", "sseqid").join(taxa, "tax_id")
    return cf.select_valid_hits(named.join(cf.small(references), "sseqid"), len(RANKS))


# -- sequences ------------------------------------------------------------------------------------------------------


@query("""select p_partkey, array_to_string(list_transform(r, lambda x: x[1]), '') as collapsed, array_to_string(list_transform(r, lambda x: chr((48 + length(x))::int)), '') as lengths
    from (select p_partkey, regexp_extract_all(upper(p_name), '(' || 'A+|B+|C+|D+|E+|F+|G+|H+|I+|J+|K+|L+|M+|N+|O+|P+|Q+|R+|S+|T+|U+|V+|W+|X+|Y+|Z+|0+|1+|2+|3+|4+|5+|6+|7+|8+|9+| +|_+|#+|-+' || ')') r from part)""")
def run_length_encode(spark, d):
    name = F.col("p_name")
    return t(spark, d, "part").select("p_partkey", sq.collapse_runs(name).alias("collapsed"), sq.encode_lengths(sq.run_lengths(name)).alias("lengths"))


@query("select p_partkey, upper(p_name) as seq from part")
def run_length_decode(spark, d):
    coded = run_length_encode(spark, d)
    return coded.select("p_partkey", sq.expand_runs(F.col("collapsed"), sq.decode_lengths(F.col("lengths"))).alias("seq"))


@query("select p_partkey, reverse(translate(upper(p_name), 'ACGTMKRYWSBVDHN', 'TGCAKMYRWSVBHDN')) as rc, translate(upper(p_name), 'ACGTMKRYWSBVDHN', 'TGCAKMYRWSVBHDN') as comp from part")
def reverse_complement(spark, d):
    return t(spark, d, "part").select("p_partkey", sq.reverse_complement(F.col("p_name")).alias("rc"), sq.complement(F.col("p_name")).alias("comp"))


@query("""select p_partkey::varchar as name, length(p_name)::int as length, round(list_avg([ascii(p_name[i]) - 33 for i in range(1, length(p_name) + 1)]), 9) as mean,
    length(regexp_replace(p_brand, '[ACGT]', '', 'g'))::int as ambig from part""")
def read_statistics(spark, d):
    p = t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("name"), F.col("p_name").alias("qual"), F.col("p_brand").alias("b"), F.col("p_name").alias("seq"))
    return ao.read_statistics(p).drop("ambig").join(p.select("name", sq.count_ambiguous(F.col("b")).alias("ambig")), "name").withColumn("mean", F.round("mean", 9))


@query("select p_partkey, substr(p_name, 3, 5) as part, case when length(regexp_replace(p_name, '[^0-9]', '', 'g')) > 0.5 * length(p_name) then true else false end as is_lengths from part")
def subsequence(spark, d):
    return t(spark, d, "part").select("p_partkey", sq.between(F.col("p_name"), F.lit(2), F.lit(7)).alias("part"), sq.looks_like_lengths(F.col("p_name")).alias("is_lengths"))


_MARKS = ["Bacillus-like", "marine organism", "putative Vibrio", "Escherichia coli ATCC 25922", "uncultured bacterium", "Taxon12", "Rothia sp. x", "vector pUC", "vectors", "hydrothermal vent", "strain K12", "Alga", "Rothia mucilaginosa", "subgroups", "Group A", "str. 5"]


@query(f"""with n as (select *, {_MARKS}[p_partkey % {len(_MARKS)} + 1] || ' ' || p_size::varchar as name from part)
    select p_partkey, replace(replace(replace(p_name, ':', '|'), ' ', '_'), 'x', '') as leaf, regexp_matches(name, '{"|".join(tf.UNCLASSIFIED)}') as doubtful, replace(p_type, ':', '_') as safe from n""")
def names(spark, d):
    marks = F.array(*[F.lit(x) for x in _MARKS])
    name = F.concat(F.get(marks, (F.col("p_partkey") % len(_MARKS)).cast("int")), F.lit(" "), F.col("p_size").cast("string"))
    return t(spark, d, "part").select("p_partkey", F.regexp_replace(tf.newick_name(F.col("p_name")), "x", "").alias("leaf"), tf.is_unclassified(name).alias("doubtful"), tf.safe_name(F.col("p_type")).alias("safe"))


# -- de-duplication and clusters -------------------------------------------------------------------------------------


def _seqs(spark, d):
    return with_order(t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("seq"), "lang", "source"), "id")


@query("select min(doc_id) as id, lang from documents group by lang, upper(text)")
def dedup_kept(spark, d):
    return cl.dedup_sequences(_seqs(spark, d), ["lang"])[0].select("id", "lang")


@query("select min(doc_id) over (partition by lang, upper(text)) as kept, doc_id as orig from documents")
def dedup_map(spark, d):
    return cl.dedup_sequences(_seqs(spark, d), ["lang"])[1]


@query("select min(doc_id) as kept, count(*) as weight from documents group by coalesce(nullif(lang, ''), source), upper(text)")
def dedup_weights(spark, d):
    return cl.dedup_sequences(_seqs(spark, d), ["lang"], ["source"])[2]


def uc(spark, d) -> DataFrame:
    e = t(spark, d, "events").select(F.concat(F.lit("e"), "event_id").alias("read"), "user_id", "event_id")
    first = e.groupBy("user_id").agg(F.min_by("read", "event_id").alias("seed"), F.count("*").alias("n"))
    rows = e.join(first, "user_id").select(F.when(F.col("read") == F.col("seed"), "S").otherwise("H").alias("type"), F.lit(None).cast("int").alias("size"), F.col("read").alias("query_label"), F.when(F.col("read") != F.col("seed"), F.col("seed")).alias("target_label"))
    return rows.unionByName(first.select(F.lit("C").alias("type"), F.col("n").cast("int").alias("size"), F.col("seed").alias("query_label"), F.lit(None).cast("string").alias("target_label")))


@query("select 'e' || event_id as read, 'e' || min(event_id) over (partition by user_id) as cluster from events")
def cluster_read_map(spark, d):
    return cl.read_map(uc(spark, d))


@query("select 'e' || min(event_id) as cluster, count(*)::double as weight from events group by user_id having count(*) >= 5")
def cluster_weights(spark, d):
    return cl.map_clusters(uc(spark, d), least=5)[2]


@query("""with n as (select event_type, count(*) n from events group by 1), r as (select event_type, (select min(n) from n) / n::double ratio from n)
    select cluster, round(sum(ratio), 9) as weight from (select 'e' || min(event_id) over (partition by user_id) as cluster, event_type from events) join r using (event_type) group by 1""")
def cluster_group_weights(spark, d):
    groups = t(spark, d, "events").select(F.concat(F.lit("e"), "event_id").alias("read"), F.col("event_type").alias("group"))
    return cl.map_clusters(uc(spark, d), groups=groups)[2].withColumn("weight", F.round("weight", 9))


@query("select 'e' || min(event_id) as cluster, count(*)::int as size from events group by user_id")
def cluster_sizes(spark, d):
    return cl.cluster_sizes(uc(spark, d))


_DNA = "translate(regexp_replace(p_brand || p_partkey, '[^0-9]', ''), '0123456789', 'ACGTACGTAC')"
_DNA_SQL = "translate(regexp_replace(p_brand || p_partkey, '[^0-9]', '', 'g'), '0123456789', 'ACGTACGTAC')"


@query(f"select p_size, (i - 1)::int as pos, s[i] as base, count(*) as n from (select p_size, {_DNA_SQL} s from part), unnest(range(1, length(s) + 1)) u(i) group by all")
def base_positions(spark, d):
    return cl.composition(t(spark, d, "part").selectExpr("p_size", f"{_DNA} as seq"), ["p_size"])


@query(f"""with c as (select p_size, i, s[i] as base, count(*) as n from (select p_size, {_DNA_SQL} s from part), unnest(range(1, length(s) + 1)) u(i) group by all),
    b as (select p_size, i, string_agg(base, '' order by base) as bases from c join (select p_size, i, max(n) n from c group by all) m using (p_size, i, n) group by all)
    select p_size, string_agg(case bases when 'AG' then 'R' when 'CT' then 'Y' when 'AC' then 'M' when 'GT' then 'K' when 'CG' then 'S' when 'AT' then 'W' when 'ACT' then 'H' when 'CGT' then 'B' when 'ACG' then 'V' when 'AGT' then 'D' when 'ACGT' then 'N' else bases end, '' order by i) as consensus from b group by p_size""")
def consensus(spark, d):
    return cl.consensus(t(spark, d, "part").selectExpr("p_size", f"{_DNA} as seq"), ["p_size"])


@query("""with n as (select l_returnflag, l_linenumber::int as pos, l_quantity::int as len, count(*) n from lineitem group by all)
    select l_returnflag, pos, arg_max(len, n * 1000 - len) as length from n group by all""")
def consensus_lengths(spark, d):
    runs = t(spark, d, "lineitem").select("l_returnflag", F.col("l_linenumber").cast("int").alias("pos"), F.col("l_quantity").cast("int").alias("len"))
    return cl.consensus_lengths(runs, ["l_returnflag"])


@query()
def denoise(spark, d):
    p = t(spark, d, "part")
    seqs = p.selectExpr("cast(p_partkey as string) as id", f"{_DNA} as seq")
    clusters = p.selectExpr("cast(p_partkey as string) as read", f"concat('b', cast(p_size as string), '_', cast(length({_DNA}) as string)) as cluster")
    return cl.denoise(seqs, clusters, aligned=True).withColumn("reads", F.array_join("reads", ","))


@query()
def cluster_chunks(spark, d):
    e = t(spark, d, "events").select(F.col("event_id").alias("id"), "event_type")
    return tb.chunks(e, 500, ["event_type"]).groupBy("event_type", "chunk").agg(F.count("*").alias("n"))


# -- tables ---------------------------------------------------------------------------------------------------------


@query("""select c_custkey, n_name, r_name from customer left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey""")
def join_left(spark, d):
    c = t(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    r = t(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    return tb.join_tables([c, t(spark, d, "nation"), r], "left").select("c_custkey", "n_name", "r_name")


@query("select s_suppkey, n_name as name, s_name as name_s from supplier join nation on s_nationkey = n_nationkey")
def join_inner(spark, d):
    s = t(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("k"), F.col("s_name").alias("name"))
    n = t(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    return tb.join_tables([s, n], "inner", ["k"]).select("s_suppkey", F.col("name_y").alias("name"), F.col("name_x").alias("name_s"))


@query("select coalesce(o_custkey, c_custkey) as k, count(o_orderkey) as n from orders full join customer on o_custkey = c_custkey group by 1")
def join_outer(spark, d):
    o = t(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey")
    return tb.join_tables([o, t(spark, d, "customer").select(F.col("c_custkey").alias("k"))], "outer", ["k"]).groupBy("k").agg(F.count("o_orderkey").alias("n"))


@query("select c_custkey as k, count(o_orderkey) as n from orders right join customer on o_custkey = c_custkey group by 1")
def join_right(spark, d):
    o = t(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey")
    return tb.join_tables([o, t(spark, d, "customer").select(F.col("c_custkey").alias("k"))], "right", ["k"]).groupBy("k").agg(F.count("o_orderkey").alias("n"))


@query("select arg_min(o_orderkey, (o_orderdate, o_orderkey)) as o_orderkey, o_custkey from orders group by o_custkey")
def dedup_first(spark, d):
    return tb.deduplicate(t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_orderkey", "o_custkey")


@query("select arg_max(o_orderkey, (o_orderdate, o_orderkey)) as o_orderkey, o_custkey from orders group by o_custkey")
def dedup_last(spark, d):
    return tb.deduplicate(t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"], last=True).select("o_orderkey", "o_custkey")


@query("select distinct o_orderstatus, o_orderpriority from orders")
def dedup_rows(spark, d):
    return tb.deduplicate(tb.project(t(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"]))


@query("select c_custkey as k, c_name as name, 'c' as kind, 1 as v from customer union all select s_suppkey, s_name, null, null from supplier")
def concatenate(spark, d):
    c = tb.add_constants(tb.project(t(spark, d, "customer"), ["c_custkey:k", "c_name:name"]), {"kind": "c", "v": 1})
    return tb.concatenate([c, tb.project(t(spark, d, "supplier"), ["s_suppkey:k", "s_name:name"])])


@query("select c_custkey, c_name, case when len(string_split(c_name, '#')) = 2 then trim(string_split(c_name, '#')[1]) else '' end as kind, case when len(string_split(c_name, '#')) = 2 then trim(string_split(c_name, '#')[2]) else '' end as number from customer")
def split_column(spark, d):
    return tb.split_column(tb.project(t(spark, d, "customer"), ["c_custkey", "c_name"]), "c_name", "#", ["kind", "number"])


@query("select o_orderkey, replace(replace(o_orderpriority, '-', '_'), 'LOW', '.') as priority from orders")
def replace_text(spark, d):
    return t(spark, d, "orders").select("o_orderkey", tb.replace_text(F.col("o_orderpriority"), [("-", "_"), ("LOW", ".")]).alias("priority"))


@query("select '>' || p_name || chr(10) || p_brand as value from part")
def fasta_lines(spark, d):
    two = tb.two_columns(t(spark, d, "part").select("p_partkey", "p_name", "p_brand"))
    return two.select(sinks.fasta_lines(F.col("description"), F.col("seq")).alias("value"))


@query("select l_returnflag, coalesce(sum(l_quantity) filter (l_linestatus = 'F'), 0) as F, coalesce(sum(l_quantity) filter (l_linestatus = 'O'), 0) as O from lineitem group by 1")
def pivot_sum(spark, d):
    return tb.pivot_sum(t(spark, d, "lineitem"), ["l_returnflag"], "l_linestatus", "l_quantity", ["F", "O"])


@query("select l_orderkey, l_linenumber, l_suppkey from (select *, rank() over (partition by l_suppkey order by l_extendedprice) r from lineitem) where r <= 3")
def best_hits(spark, d):
    return tb.best_ranked(t(spark, d, "lineitem"), ["l_suppkey"], "l_extendedprice", 3).select("l_orderkey", "l_linenumber", "l_suppkey")


@query("select l_orderkey, l_linenumber from (select *, row_number() over (partition by l_orderkey order by l_quantity desc, l_linenumber) r from lineitem) where r = 1")
def largest_per_group(spark, d):
    return tb.largest_per_group(t(spark, d, "lineitem"), ["l_orderkey"], "l_quantity", ["l_linenumber"]).select("l_orderkey", "l_linenumber")


@query("select o_orderkey, round(greatest(0.01::double, o_totalprice / sum(o_totalprice) over (partition by o_custkey) * 100), 6) as pct from orders")
def percent_of_group(spark, d):
    return tb.percent_of(t(spark, d, "orders"), "o_totalprice", ["o_custkey"], "pct", 0.01).select("o_orderkey", F.round("pct", 6).alias("pct"))


@query("select c_custkey, o_orderkey from customer left join orders on c_custkey = o_custkey")
def with_no_hits(spark, d):
    o = t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    c = t(spark, d, "customer")
    return tb.with_missing(o.join(c, "c_custkey", "left_semi"), c, "c_custkey").select("c_custkey", "o_orderkey")


@query("select arg_max(value, event_id) as value, user_id from events group by user_id")
def lookup_last(spark, d):
    return read_lookup(with_order(t(spark, d, "events"), "event_id"), "user_id", "value")


@query("select event_type, (row_number() over (order by min(event_id)) - 1)::int as position from events group by event_type")
def first_appearance(spark, d):
    return first_position(with_order(t(spark, d, "events"), "event_id"), "event_type")


@query("select event_id from events where value >= 10 and value <= 60")
def bounds(spark, d):
    return t(spark, d, "events").where(tb.within(F.col("value"), 10, 60)).select("event_id")


@query()
def group_sample(spark, d):
    e = t(spark, d, "events").select(F.col("event_id").alias("id"), "event_type")
    return tb.sample_per_group(e, ["event_type"], 20)


@query("""with c as (select p_size::double v, count(*) n from part group by 1), x as (select unnest([1.0, 10.0, 25.0, 50.0])::double as value)
    select value, round(sum(exp(-power((value - v) / 2.0, 2) / 2) * n) / ((select count(*) from part) * 2.0 * sqrt(2 * pi())), 9) as density from x, c group by value""")
def length_density(spark, d):
    return sinks.length_density(t(spark, d, "part"), "p_size", [1.0, 10.0, 25.0, 50.0], 2.0).withColumn("density", F.round("density", 9))


# -- alignments -------------------------------------------------------------------------------------------------------


@query("""select o_orderkey, l_linenumber, case when r = q then 'equal' when contains(r, '-') or contains(q, '-') then 'indel' when length(r) = 1 and length(q) = 1 then 'snp'
    when list_sort(list_distinct(string_split(replace(r, '=', ''), ''))) = list_sort(list_distinct(string_split(replace(q, '=', ''), ''))) then 'homoindel' else 'compound' end as category
    from (select l_orderkey as o_orderkey, l_linenumber, substr('AAC-GTT=AA', 1 + (l_partkey % 8)::int, 1 + (l_suppkey % 2)::int) as r, substr('AC-AGTT=A=', 1 + (l_partkey % 7)::int, 1 + (l_suppkey % 2)::int) as q from lineitem)""")
def error_categories(spark, d):
    rows = t(spark, d, "lineitem").selectExpr("l_orderkey as o_orderkey", "l_linenumber", "substr('AAC-GTT=AA', 1 + cast(l_partkey % 8 as int), 1 + cast(l_suppkey % 2 as int)) as r", "substr('AC-AGTT=A=', 1 + cast(l_partkey % 7 as int), 1 + cast(l_suppkey % 2 as int)) as q")
    return rows.select("o_orderkey", "l_linenumber", al.error_category(F.col("r"), F.col("q")).alias("category"))


@query("""select l_orderkey, l_linenumber, (l_quantity::int - l_linenumber::int + 1) / 100::double * 100 as percent, (l_quantity::int - l_linenumber::int) / 100::double as open, (l_quantity::int - l_linenumber::int + 1) / 80::double as fraction, 1 - l_discount as distance from lineitem""")
def coverages(spark, d):
    a, b = F.col("l_linenumber").cast("int"), F.col("l_quantity").cast("int")
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", al.coverage_percent(a, b, F.lit(100)).alias("percent"), al.coverage_open(a, b, F.lit(100)).alias("open"), al.coverage_fraction(a, b, F.lit(80)).alias("fraction"), ao.distance(F.col("l_discount")).alias("distance"))


@query("""select l_orderkey, l_linenumber, l_quantity::int as "left", l_linenumber::int - 1 as left_in, case when l_returnflag = 'R' then l_quantity::int - 1 else l_linenumber::int - 1 end as "right", case when l_returnflag = 'R' then l_linenumber::int else l_quantity::int end as right_in from lineitem where l_returnflag <> 'X'""")
def primer_positions(spark, d):
    a, b, f = F.col("l_linenumber").cast("int"), F.col("l_quantity").cast("int"), F.when(F.col("l_returnflag") == "R", "r").otherwise("f")
    forward = F.lit("f")
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", al.primer_position("left", False, a, b, forward).alias("left"), al.primer_position("left", True, a, b, forward).alias("left_in"), al.primer_position("right", False, a, b, f).alias("right"), al.primer_position("right", True, a, b, f).alias("right_in"))


_LIKE_SQL = """case q when 'A' then t in ('A','R','M','W','H','V','D','N') when 'C' then t in ('C','Y','M','S','H','B','V','N') when 'G' then t in ('G','R','K','S','B','V','D','N') when 'T' then t in ('T','Y','K','W','H','B','D','N')
    when 'R' then t not in ('C','T','Y') when 'N' then true else q = t end"""


@query(f"""with s as (select p_partkey, translate(p_partkey::varchar || '0123456789', '0123456789', 'ACGTRNacg-') a, translate('3141592653' || p_size::varchar, '0123456789', 'ACGTACGTRN') b from part),
    e as (select p_partkey, a, b, unnest(range(1, least(length(a), length(b)) + 1)) i from s), c as (select p_partkey, i, a[i] q, b[i] t from e),
    d as (select *, q = t or (q in ('A','C','G','T','R','N') and {_LIKE_SQL}) same from c)
    select p_partkey, string_agg(case when same then '.' else lower(q) end, '' order by i) as q, string_agg(case when same then t else lower(t) end, '' order by i) as t from d group by p_partkey""")
def differences(spark, d):
    seqs = t(spark, d, "part").select("p_partkey", F.translate(F.concat(F.col("p_partkey").cast("string"), F.lit("0123456789")), "0123456789", "ACGTRNacg-").alias("a"), F.translate(F.concat(F.lit("3141592653"), F.col("p_size").cast("string")), "0123456789", "ACGTACGTRN").alias("b"))
    return seqs.select("p_partkey", al.shown_difference(F.col("a"), F.col("b")).alias("x")).select("p_partkey", "x.*")


@query("""with p as (select o_orderstatus a, o_orderpriority b, o_totalprice score from orders), m as (select * from p union all select b, a, score from p)
    select a, b, ceil(median(score) * 100) / 100 as score from m group by all""")
def pair_medians(spark, d):
    return ao.pair_medians(t(spark, d, "orders").select(F.col("o_orderstatus").alias("a"), F.col("o_orderpriority").alias("b"), F.col("o_totalprice").alias("score")))


def _alignments(spark, d) -> DataFrame:
    rows = t(spark, d, "lineitem").select(F.concat_ws("_", "l_orderkey", "l_linenumber").alias("q_name"), F.lit("ref").alias("t_name"), F.substring(F.translate(F.concat("l_partkey", F.lit("0123456789"), "l_suppkey"), "0123456789", "ACGT-ACGTA"), 1, 10).alias("q_seq"), F.lit("ACGTTACGAA").alias("t_seq"), F.col("l_linenumber").cast("int").alias("q_al_start"))
    return rows.withColumn("q_al_stop", F.lit(10)).withColumn("t_sq_len", F.lit(10)).withColumn("sw_zscore", F.col("q_al_start") * 10.0).withColumn("_ord", F.struct("q_name"))


@query()
def error_tallies(spark, d):
    return ao.error_tallies(_alignments(spark, d))


@query()
def run_transitions(spark, d):
    return ao.run_transitions(ao.errors_of(_alignments(spark, d)))


@query("""select n, s::bigint as n_reads from (select 'fail_len' n, count(*) filter (length(p_name) < 8) s from part) where n = 'fail_len'""")
def barcode_failures(spark, d):
    reads = t(spark, d, "part").select("p_partkey", F.col("p_name").alias("seq"))
    counts = ao.split_barcodes(reads, {"a": "part", "b": "x1y2"}, least=8)[1]
    return counts.where("outcome = 'fail_len'").select(F.col("outcome").alias("n"), F.col("n").alias("n_reads"))


@query()
def shown_differences(spark, d):
    """Whole strings, with the operator's own results for both sides."""
    diff = al.shown_difference(F.col("p_name"), F.col("p_brand"))
    return t(spark, d, "part").select("p_partkey", "p_name", "p_brand", diff["q"].alias("q"), diff["t"].alias("t"))


def _split_barcodes(spark, d) -> tuple[DataFrame, DataFrame]:
    return ao.split_barcodes(t(spark, d, "part").select("p_partkey", F.col("p_name").alias("seq")), {"a": "part", "b": "x1y2"}, least=8)


@query()
def barcode_reads(spark, d):
    """All reads within the bounds, with their samples."""
    return _split_barcodes(spark, d)[0]


@query()
def barcode_counts(spark, d):
    return _split_barcodes(spark, d)[1]


@query()
def local_alignments(spark, d):
    p = t(spark, d, "supplier").selectExpr("cast(s_suppkey as string) as id", "translate(concat(s_name, s_name, cast(s_suppkey * 7919 as string)), '0123456789Suplier#', 'ACGTACGTACACGTACG') as seq")
    n = t(spark, d, "nation").selectExpr("cast(n_nationkey as string) as id", "translate(upper(concat(n_name, n_name, cast(n_nationkey * 7919 as string), '000000')), '0123456789BDEFHIJKLMNOPQRSUVWXYZ# ', 'ACGTACGTACACGTACGTACGTACGTACGTACGT') as seq")
    return kn.search(n, p, identity=0.5, k=6)


# -- taxonomy and classification ---------------------------------------------------------------------------------------


@query(SQL_BASE + "select tax_id, parent_id, \"rank\", tax_name, root, family, genus, species from tax")
def taxonomy_table(spark, d):
    return taxonomy(spark, d)


@query(SQL_BASE + """select t.tax_id, t.tax_name, t."rank", p.tax_id as parent_id, p.tax_name as parent_name, p."rank" as parent_rank from tax t join tax p on p.tax_id in ('r1', 'n2', 'n24') and list_contains([t.root, t.family, t.genus, t.species], p.tax_id)
    where not (p.tax_id = 'r1' and coalesce(t.genus, '') in ('n2', 'n24'))""")
def taxon_children(spark, d):
    tax = taxonomy(spark, d)
    region = tx.children(tax.where("genus is null or genus not in ('n2', 'n24')"), ["r1"], RANKS)
    return region.unionByName(tx.children(tax, ["n2", "n24"], RANKS)).select("tax_id", "tax_name", "rank", "parent_id", "parent_name", "parent_rank")


@query(SQL_BASE + "select tax_id, 85.0::double as root, case when family = 'r1' then 91.0 else 90.0 end::double as family, case when family = 'r1' then 95.0 else 94.0 end::double as genus, case when family = 'r1' then 98.0 else 97.0 end::double as species from tax")
def taxon_thresholds(spark, d):
    long = thresholds(spark).unpivot(["tax_id"], RANKS, "target_rank", "low")
    return tx.thresholds_of_taxa(taxonomy(spark, d), long, RANKS)


@query(SQL_BASE + "select tax_id, thr[1] as root, thr[2] as family, thr[3] as genus, thr[4] as species from lin")
def resolved_thresholds(spark, d):
    got = tx.resolved_thresholds(tx.lineages(taxonomy(spark, d), RANKS), tx.threshold_arrays(thresholds(spark), RANKS))
    return got.select("tax_id", *[F.col("thr")[i].alias(r) for i, r in enumerate(RANKS)])


@query("select '1' as tax_id, 85.0::double as root, 90.0::double as family, 93.5::double as genus, 97.0::double as species union all select 'r1', 85, 91, 95, 98 union all select 'n3', null, null, null, 99")
def overridden_thresholds(spark, d):
    own = spark.createDataFrame([("1", None, None, 93.5, None), ("n3", None, None, None, 99.0)], "tax_id string, root double, family double, genus double, species double")
    return tx.overridden(thresholds(spark), own, RANKS)


@query(SQL_BASE + "select specimen, qseqid, sseqid, mismatch, assignment_tax_id, assignment_threshold from valid")
def valid_hits_of_queries(spark, d):
    return valid_hits(spark, d).select("specimen", "qseqid", "sseqid", "mismatch", "assignment_tax_id", "assignment_threshold")


@query(SQL_BASE + "select specimen, qseqid, array_to_string(list_sort(list(distinct assignment_tax_id)), ',') as ids from valid group by all")
def assignment_sets(spark, d):
    return valid_hits(spark, d).groupBy("specimen", "qseqid").agg(F.array_join(F.array_sort(F.collect_set("assignment_tax_id")), ",").alias("ids"))


_TEXT_SQL = """, named as (select specimen, tax_name as name, bool_or(pident >= 99) as starred from valid join tax on tax.tax_id = assignment_tax_id group by 1, 2),
    parts as (select specimen, case when len(string_split(name, ' ')) = 2 then string_split(name, ' ')[1] end genus, case when len(string_split(name, ' ')) = 2 then string_split(name, ' ')[2] else name end word, case when len(string_split(name, ' ')) <> 2 then name end alone, starred from named),
    g as (select specimen, genus, alone, case when genus is null then '' else genus || ' ' end || string_agg(word || case when starred then '*' else '' end, '/' order by word, starred) as part from parts group by specimen, genus, alone)
    select specimen, string_agg(part, ';' order by part) as assignment from g group by specimen"""


@query(SQL_BASE.rstrip() + _TEXT_SQL.replace("tax_name as name", "tax.tax_name as name"))
def assignment_texts(spark, d):
    v = valid_hits(spark, d).select("specimen", "assignment_tax_id", "pident")
    names = taxonomy(spark, d).select(F.col("tax_id").alias("assignment_tax_id"), F.col("tax_name").alias("name"))
    return tx.assignment_text(v.join(names, "assignment_tax_id").withColumn("starred", tx.starred(F.col("pident"), 99)), ["specimen"])


@query("""with n as (select o_custkey, o_orderpriority p, count(*) n from orders group by all)
    select o_custkey, arg_max(p, n * 10 + case p when '1-URGENT' then 0 when '2-HIGH' then 1 when '3-MEDIUM' then 2 when '4-NOT SPECIFIED' then 3 when '5-LOW' then 4 else -1 end) as best_rank from n group by 1""")
def best_ranks(spark, d):
    o = t(spark, d, "orders").select("o_custkey", F.col("o_orderpriority").alias("rank"))
    return tx.best_rank(o, ["o_custkey"], ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"])


@query(SQL_BASE + """, c as (select 'n' || n_nationkey tax_id, (n_nationkey % 5 + 1)::double median from nation)
    select specimen, round(avg(coalesce(median, 2.0)), 9) as correction from (select distinct specimen, assignment_tax_id from valid) v left join c on c.tax_id = assignment_tax_id group by 1""")
def copy_corrections(spark, d):
    copies = t(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("tax_id"), (F.col("n_nationkey") % 5 + 1).cast("double").alias("median")).union(spark.createDataFrame([("1", 2.0)], "tax_id string, median double"))
    return tx.mean_copies(valid_hits(spark, d), copies, ["specimen"]).withColumn("correction", F.round("correction", 9))


@query("""with r as (select user_id, event_type, count(*)::double reads from events group by all)
    select user_id, event_type, reads, (row_number() over (partition by user_id order by reads desc, event_type desc) - 1)::varchar as assignment_id from r""")
def assignment_numbers(spark, d):
    r = t(spark, d, "events").groupBy(F.col("user_id").alias("specimen"), F.col("event_type").alias("assignment")).agg(F.count("*").cast("double").alias("reads"))
    numbers = cf.numbered(r.withColumns({"clusters": F.lit(1), "key": F.lit("")}), "reads")
    return numbers.select(F.col("specimen").alias("user_id"), F.col("assignment").alias("event_type"), "reads", "assignment_id")


@query()
def classify_hits(spark, d):
    """The flagship: summary with condensed groups."""
    return cf.classify(hits(spark, d), seq_info(spark, d), taxonomy(spark, d), thresholds(spark), specimens=specimens(spark, d), star=99.0)[0]


@query()
def classify_details(spark, d):
    copies = t(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("tax_id"), (F.col("n_nationkey") % 5 + 1).cast("double").alias("median")).union(spark.createDataFrame([("1", 2.0)], "tax_id string, median double"))
    return cf.classify(hits(spark, d), seq_info(spark, d), taxonomy(spark, d), thresholds(spark), specimens=specimens(spark, d), copies=copies, best_n=3)[1]


@query(SQL_BASE.rstrip() + """, best as (select * from (select *, rank() over (partition by specimen, qseqid order by mismatch) k from valid) where k <= 3),
    keys as (select specimen, qseqid, list_sort(list(distinct assignment_tax_id)) k from best group by all),
    hit as (select best.*, keys.k as key from best join keys using (specimen, qseqid)),
    asked as (select distinct specimen, qseqid from hits join spec using (qseqid)),
    every as (select asked.specimen, asked.qseqid, coalesce(hit.key, []) as key, pident, assignment_threshold, assignment_tax_id from asked left join hit using (specimen, qseqid)),
    stat as (select specimen, key, max(pident) max_percent, min(pident) min_percent, min(assignment_threshold) min_threshold, count(distinct qseqid) clusters, count(distinct qseqid)::double reads from every group by all)
    select specimen, array_to_string(key, ',') as key, max_percent, min_percent, min_threshold, clusters, reads, round(greatest(0.01::double, reads / sum(reads) over (partition by specimen) * 100), 6) as pct_reads from stat""")
def classify_split(spark, d):
    """Summary without condensing, by the sets of assigned taxa: each set's text is unique, so it is compared by its ids."""
    s, det = cf.classify(hits(spark, d), seq_info(spark, d), taxonomy(spark, d), thresholds(spark), specimens=specimens(spark, d), best_n=3, split=True, star=1000.0)
    key = det.groupBy("specimen", "assignment_id").agg(F.array_join(F.array_sort(F.collect_set("assignment_tax_id")), ",").alias("key"))
    return s.join(key, ["specimen", "assignment_id"], "left").select("specimen", F.coalesce("key", F.lit("")).alias("key"), "max_percent", "min_percent", "min_threshold", "clusters", "reads", F.round("pct_reads", 6).alias("pct_reads"))


@query()
def classify_by_identity(spark, d):
    out = cf.classify_by_identity(hits(spark, d), seq_info(spark, d), taxonomy(spark, d), "species", specimens=specimens(spark, d), high=98.0, low=94.0, max_ambiguous=2)
    return out


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
