"""Tables of alignments: search results, errors, primers, compositions, distances, read statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlake.functions.alignment import coverage_fraction, error_category, itemize_errors, match_barcode, primer_position, shown_difference, tally_errors
from seqlake.functions.sequence import GAP, RUN_GAP, between, characters, count_ambiguous, mean_phred, reverse_complement
from seqlake.functions.text import is_type_strain, is_unclassified, safe_name, taxid_of_features

# Names of a database search's columns as those of an alignment table.
SEARCH_NAMES = {"query": "q_name", "target": "t_name", "identity": "sw_ident", "length": "sw_overlap", "qstart": "q_al_start", "qend": "q_al_stop", "tstart": "t_al_start", "tend": "t_al_stop"}


def fields_of(alignments: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Typed columns of the alignments' fields; wanted: name -> SQL type."""
    return alignments.select("q_name", "t_name", "q_seq", "t_seq", *[F.try_element_at("fields", F.lit(k)).cast(t).alias(k) for k, t in wanted.items()], "_ord")


def above_score(alignments: DataFrame, least: float | None, column: str = "sw_zscore") -> DataFrame:
    return alignments.where(F.col(column) >= least) if least else alignments


def top_hits(alignments: DataFrame) -> DataFrame:
    """The first alignment of each query, in the order of the file."""
    rest = [c for c in alignments.columns if c != "q_name"]
    first = alignments.groupBy("q_name").agg(F.min_by(F.struct(*rest), "_ord").alias("r"))
    return first.select(*[F.col("q_name") if c == "q_name" else F.col(f"r.{c}").alias(c) for c in alignments.columns])


def with_difference(alignments: DataFrame) -> DataFrame:
    """alignments with q_diff, t_diff over the aligned slices (q_al_start .. q_al_stop, t_al_start .. t_al_stop, from 1) of
    the sequences without their outer gaps."""
    inner = lambda c: F.regexp_replace(c, f"^{GAP}+|{GAP}+$", "")
    q = F.substr(inner("q_seq"), F.col("q_al_start"), F.col("q_al_stop") - F.col("q_al_start") + 1)
    t = F.substr(inner("t_seq"), F.col("t_al_start"), F.col("t_al_stop") - F.col("t_al_start") + 1)
    return alignments.withColumn("__d", shown_difference(q, t)).withColumns({"q_diff": F.col("__d.q"), "t_diff": F.col("__d.t")}).drop("__d")


def search_as_alignments(found: DataFrame) -> DataFrame:
    """A database search's table under an alignment table's names; identity as a fraction, with the covered fraction."""
    out = found.withColumnsRenamed({k: v for k, v in SEARCH_NAMES.items() if k in found.columns})
    return out.withColumn("sw_ident", F.col("sw_ident") / 100).withColumn("coverage", coverage_fraction(F.col("q_al_start"), F.col("q_al_stop"), F.col("sw_overlap")))


def errors_of(alignments: DataFrame) -> DataFrame:
    """q_name, t_name, i, ref, query, category: the pieces of each alignment (t_seq is the reference)."""
    items = alignments.select("q_name", "t_name", F.explode(itemize_errors("t_seq", "q_seq")).alias("e"))
    return items.select("q_name", "t_name", "e.*").withColumn("category", error_category(F.col("ref"), F.col("query")))


def error_tallies(alignments: DataFrame) -> DataFrame:
    """q_name, t_name, snp, indel, homoindel, compound, total, length (of the reference without gaps).

    The pieces are counted where they are found, so an alignment is one row of the sums.
    """
    rows = alignments.select("q_name", "t_name", tally_errors("t_seq", "q_seq").alias("e")).where("e.pieces > 0")
    kinds = ["snp", "indel", "homoindel", "compound", "total", "length"]
    return rows.groupBy("q_name", "t_name").agg(*[F.sum(f"e.{k}").alias(k) for k in kinds])


def run_transitions(errors: DataFrame, most: int = 6) -> DataFrame:
    """base, ref_length and a column for each query length: how runs of a base were read, from none at all (row 0: a base
    that the reference lacks). Pieces with more than one letter, outer gaps aside, don't count. Lengths of `most` and more
    count as geq<most>; base `total` sums the bases."""
    inner = lambda c: F.regexp_replace(c, f"^[{GAP}{RUN_GAP}]+|[{GAP}{RUN_GAP}]+$", "")
    runs = errors.select(inner("ref").alias("r"), inner("query").alias("q")).where(F.concat("r", "q").rlike(r"(?s)^(.)\1*$"))
    capped = lambda c: F.when(F.length(c) >= most, F.lit(f"geq{most}")).otherwise(F.length(c).cast("string"))
    base = F.substr(F.concat("r", "q"), F.lit(1), F.lit(1))
    rows = runs.select(F.explode(F.array(base, F.lit("total"))).alias("base"), capped("r").alias("ref_length"), capped("q").alias("q"))
    return rows.groupBy("base", "ref_length").pivot("q", [*map(str, range(most)), f"geq{most}"]).count().fillna(0)


def positions(alignments: DataFrame, side: str, include: bool, least: int | None = None, most: int | None = None, score: float | None = None, where: str | None = None) -> DataFrame:
    """name, position of each read's first alignment, if that passes; where: an SQL condition over its columns."""
    first = top_hits(alignments)
    if least is not None:
        first = first.where(F.col("q_al_start") >= least)
    if most is not None:
        first = first.where(F.col("q_al_start") <= most)
    if score is not None:
        first = first.where(F.col("sw_zscore") >= score)
    if where:
        first = first.where(F.expr(where))
    frame = F.col("sw_frame") if "sw_frame" in alignments.columns else F.lit("f")
    return first.select(F.col("q_name").alias("name"), primer_position(side, include, F.col("q_al_start"), F.col("q_al_stop"), frame).alias("position"))


def trim_primers(seqs: DataFrame, left: DataFrame | None = None, right: DataFrame | None = None, keep_all: bool = False, rle: DataFrame | None = None) -> DataFrame:
    """seqs cut to between the left and the right position; without keep_all only reads that have both stay. Empty results go.

    rle: name, rle with the run lengths of the reads, cut likewise.
    """
    out = seqs
    how = "left" if keep_all else "inner"
    for side, table in (("left", left), ("right", right)):
        out = out.withColumn(f"__{side}", F.lit(None).cast("int")) if table is None else out.join(table.select(F.col("name").alias("id"), F.col("position").cast("int").alias(f"__{side}")), "id", how)
    start, stop = F.coalesce("__left", F.lit(0)), F.col("__right")
    out = out.withColumn("seq", between(F.col("seq"), start, stop))
    if rle is not None:
        out = out.join(rle.select(F.col("name").alias("id"), "rle"), "id").withColumn("rle", between(F.col("rle"), start, stop))
    return out.drop("__left", "__right").where("seq <> ''")


def base_composition(alignments: DataFrame, info: DataFrame, rank: str = "species", score: float | None = None, full_length: bool = True) -> DataFrame:
    """id, rank_id, pos, expected, A, T, G, C, N, naligns, nseqs: bases read at each place of the (single) target, by the reads' taxon.

    info: seqname and a column of rank ids (species where it is empty).
    """
    total = alignments.agg(F.countDistinct("q_name").alias("nseqs"))
    rows = above_score(alignments, score)
    if full_length:
        rows = rows.where(F.col("q_al_stop") - F.col("q_al_start") == F.col("t_sq_len") - 1)
    own = info.select(F.col("seqname").alias("q_name"), F.coalesce(F.nullif(F.col(rank), F.lit("")), F.col("species")).alias("rank_id"))
    rows = rows.join(own, "q_name")
    q = F.substr("q_seq", F.col("q_al_start"), F.col("q_al_stop") - F.col("q_al_start") + 1)
    each = rows.select("t_name", "rank_id", "t_seq", F.posexplode(characters(F.upper(q))).alias("pos", "base"))
    counts = each.groupBy("t_name", "rank_id", "pos").agg(F.max(F.substr("t_seq", F.col("pos") + 1, F.lit(1))).alias("expected"), *[F.count_if(F.col("base") == b).alias(b) for b in "ATGC"], F.count_if(~F.col("base").isin(*"ATGC")).alias("N"), F.count("*").alias("naligns"))
    return counts.crossJoin(F.broadcast(total)).orderBy("t_name", "rank_id", "pos")  # one row


def pair_medians(pairs: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """a, b, score: median over the pairs of two groups (both ways), rounded up to hundredths. pairs: a, b, score."""
    both = pairs.select("a", "b", "score").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))
    if groups is not None:
        for side in "ab":
            both = both.join(groups.select(F.col("seqname").alias(side), F.col("group").alias(f"g{side}")), side)
        both = both.select(F.col("ga").alias("a"), F.col("gb").alias("b"), "score")
    return both.groupBy("a", "b").agg((F.ceil(F.median("score") * 100) / 100).alias("score"))


def distance_matrix(medians: DataFrame, names: list[str]) -> DataFrame:
    """A row for each name and a column for each; what is missing is 0."""
    return medians.groupBy("a").pivot("b", names).agg(F.max("score")).fillna(0)


def distance(identity: Column) -> Column:
    return 1 - identity


def read_statistics(reads: DataFrame) -> DataFrame:
    """name, length, mean, ambig of FASTQ records."""
    return reads.select(safe_name(F.col("name")).alias("name"), F.length("seq").alias("length"), mean_phred(F.col("qual")).alias("mean"), count_ambiguous(F.col("seq")).alias("ambig"))


def split_barcodes(reads: DataFrame, barcodes: dict[str, str], window: int = 20, least: int | None = None, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(reads with sample, bc_start, kind; counts by outcome). Reads out of the length bounds aren't matched."""
    fits = F.lit(True)
    if least is not None:
        fits = fits & (F.length("seq") >= least)
    if most is not None:
        fits = fits & (F.length("seq") <= most)
    marked = reads.withColumn("__fits", fits)
    found = marked.where("__fits").withColumn("__m", match_barcode(barcodes, window)("seq")).select(*reads.columns, "__m.*")
    failed = marked.where("not __fits").agg(F.count("*").alias("n")).select(F.lit("fail_len").alias("outcome"), "n")
    by = found.groupBy(F.coalesce("sample", F.lit("no_match")).alias("outcome")).agg(F.count("*").alias("n"))
    all_ = found.where("sample is not null").agg(F.count("*").alias("n")).select(F.lit("total_matched").alias("outcome"), "n")
    return found, by.unionByName(all_).unionByName(failed)


def record_sequences(records: DataFrame, region: tuple[int, int] | None = None, feature: str | None = None, product: list[str] | None = None, minus: bool = False, least: int | None = None, most: int | None = None, max_ambiguous: int | None = None, types_only: bool = False, classified_only: bool = False) -> DataFrame:
    """id, accession, description, seq of flat-file records: whole, a region (start from 0, end excluded), or their features
    of one type or with one of the products.

    A feature on the minus strand is turned, and a whole record or region by the strand of its source feature; with minus
    those on the plus strand are turned as well. Records without a source feature stay as they are.
    """
    rows = records
    if types_only:
        rows = rows.where(is_type_strain(F.col("description")))
    if classified_only:
        rows = rows.where(~is_unclassified(F.col("description")))
    turned = lambda strand: F.coalesce((strand == -1) | (F.lit(minus) & (strand == 1)), F.lit(False))
    if feature or product:
        rows = rows.select("name", "id", "description", "seq", "features", F.explode("features").alias("f"))
        if feature:
            rows = rows.where(F.col("f.type") == feature)
        if product:
            rows = rows.where(F.arrays_overlap(F.coalesce(F.try_element_at("f.qualifiers", F.lit("product")), F.array().cast("array<string>")), F.array(*[F.lit(p) for p in product])))
        cut = between(F.col("seq"), F.col("f.start"), F.col("f.end"))
        tag = F.coalesce(F.get(F.try_element_at("f.qualifiers", F.lit("locus_tag")), F.lit(0)), F.lit("unspecified"))
        name, turn = F.concat_ws("_", "name", tag), turned(F.col("f.strand"))
    else:
        turn = turned(F.get(F.filter("features", lambda f: f["type"] == "source"), F.lit(0))["strand"])
        cut, name = F.col("seq"), F.col("name")
        if region:
            cut, name = between(F.col("seq"), F.lit(region[0]), F.lit(region[1])), F.concat_ws("_", "name", F.lit(region[0]), F.lit(region[1]))
    out = rows.select(name.alias("id"), F.col("id").alias("accession"), "description", F.when(turn, reverse_complement(cut)).otherwise(cut).alias("seq"), "features")
    if (feature or product) and max_ambiguous is not None:
        out = out.where(count_ambiguous(F.col("seq")) <= max_ambiguous)
    if least is not None:
        out = out.where(F.length("seq") >= least)
    if most is not None:
        out = out.where(F.length("seq") <= most)
    return out


def record_info(sequences: DataFrame) -> DataFrame:
    """seqname, tax_id, accession, description, length, ambig_count of record_sequences()."""
    return sequences.select(F.col("id").alias("seqname"), taxid_of_features(F.col("features")).alias("tax_id"), "accession", "description", F.length("seq").alias("length"), count_ambiguous(F.col("seq")).alias("ambig_count"))


def edit_tree(trees: DataFrame, names: dict[str, str] | None = None, remove: str | None = None, prefix: str = "", suffix: str = "") -> DataFrame:
    """Trees with new leaf names; with names only the leaves found there are edited. names: bounded by one tree's leaves."""
    from seqlake.functions.text import newick_name

    leaf = r"(?<=[(,])[^(),:;]+"
    found = F.regexp_extract_all("tree", F.lit(leaf), F.lit(0))
    if names is not None:
        table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv]) if names else F.create_map().cast("map<string,string>")
        new = lambda x: F.coalesce(newick_name(F.try_element_at(table, F.trim(x)), prefix, suffix, remove), x)
    else:
        new = lambda x: newick_name(x, prefix, suffix, remove)
    parts = F.split("tree", leaf, -1)
    return trees.withColumn("__n", F.transform(found, new)).withColumn("tree", F.array_join(F.transform(parts, lambda x, i: F.concat(x, F.coalesce(F.get("__n", i), F.lit("")))), "")).drop("__n")


def pull_reads(seqs: DataFrame, samples: DataFrame, sample: str) -> DataFrame:
    """Reads whose description is mapped to the sample (samples: sequence_id, sample)."""
    return seqs.join(samples.where(F.col("sample") == sample).select(F.col("sequence_id").alias("description")), "description", "left_semi")
