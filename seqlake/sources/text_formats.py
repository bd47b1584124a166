"""Scans of text formats. Each gives `_ord`, by which rows can be put in the order of the files.

FASTA, tables, cluster and score files are read by Spark's own readers; formats whose records depend on the lines before
them (FASTQ, pairwise alignments, flat files) are cut into records in the reader or per file by a partition function.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UC_SCHEMA = "type string, cluster_number int, size int, pct_id string, strand string, query_start string, seed_start string, alignment string, query_label string, target_label string"
BLAST_SCHEMA = "qseqid string, sseqid string, pident double, qstart int, qend int, qlen int, qcovs double"
BLAST6_SCHEMA = "query string, target string, identity double, length int, mismatch int, gapopen int, qstart int, qend int, tstart int, tend int, evalue double, bits double"


def _ord():
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))


def limited(df: DataFrame, limit: int | None) -> DataFrame:
    """The first rows in the order of the files; all if limit is None."""
    return df if limit is None else df.orderBy("_ord").limit(limit)


def read_fasta(spark: SparkSession, path: str | list[str], limit: int | None = None, drop_last_empty: bool = True) -> DataFrame:
    """id, description, seq, _ord. Records without sequence stay, save the last one of a file (for which files are read
    once more; without drop_last_empty it stays too)."""
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.col("value"), _ord().alias("_ord"))
    text = F.regexp_replace(F.regexp_replace("value", "\r", ""), "^>", "")
    parts = raw.select(F.split(text, "\n", 2).alias("p"), "_ord").where(F.trim(F.col("p")[0]) != "")
    head = F.trim(F.col("p")[0])
    seq = F.regexp_replace(F.coalesce(F.get("p", F.lit(1)), F.lit("")), r"\s", "")
    out = parts.select(F.split(head, r"\s+", 2)[0].alias("id"), head.alias("description"), seq.alias("seq"), "_ord")
    if drop_last_empty:
        last = out.groupBy(F.col("_ord.file")).agg(F.max(F.struct(F.col("_ord").alias("_ord"), (F.col("seq") == "").alias("empty"))).alias("last"))  # a row for each file
        out = out.join(last.where("last.empty").select("last._ord"), "_ord", "left_anti").select("id", "description", "seq", "_ord")
    return limited(out, limit)


def read_fastq(spark: SparkSession, path: str | list[str], limit: int | None = None) -> DataFrame:
    """name, description, seq, qual, _ord; records of four lines."""
    whole = spark.read.text(path, wholetext=True).select(F.col("value"), F.col("_metadata.file_path").alias("file"))
    record = whole.select("file", F.split(F.rtrim(F.regexp_replace("value", "\r", "")), "\n").alias("l"))
    each = record.select("file", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor(F.size("l") / 4).cast("int") - 1), lambda i: F.slice("l", i * 4 + 1, 4))).alias("i", "r")).where(F.size("r") == 4)
    head = F.substr(F.col("r")[0], F.lit(2))
    out = each.select(F.split(head, r"\s+", 2)[0].alias("name"), head.alias("description"), F.col("r")[1].alias("seq"), F.col("r")[3].alias("qual"), F.struct("file", F.lit(0).cast("long").alias("block"), F.col("i").cast("long").alias("row")).alias("_ord"))
    return limited(out, limit)


def read_table(spark: SparkSession, path: str | list[str], sep: str = ",", header: bool = True, names: list[str] | None = None, schema: str | None = None, comment: str | None = None, limit: int | None = None, null_value: str | None = None) -> DataFrame:
    """A delimited file; strings unless a schema is given. Headerless columns are _c0 .. _cN or names. Suffixes .gz and .bz2 are read through."""
    reader = spark.read.option("sep", sep).option("header", header).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE")
    if comment:
        reader = reader.option("comment", comment)
    if null_value is not None:
        reader = reader.option("nullValue", null_value)
    if schema:
        reader = reader.schema(schema)
    df = reader.csv(path)
    if names:
        df = df.toDF(*names)
    return limited(df.select("*", _ord().alias("_ord")), limit)


def read_blast(spark: SparkSession, path: str | list[str], schema: str = BLAST_SCHEMA, sep: str = ",", limit: int | None = None) -> DataFrame:
    return read_table(spark, path, sep=sep, header=False, schema=schema, limit=limit)


def read_clusters(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A cluster file of ten columns; `*` is null."""
    return read_table(spark, path, sep="\t", header=False, schema=UC_SCHEMA, null_value="*")


def read_lookup(df: DataFrame, key: str, *values: str) -> DataFrame:
    """key and values with one row for each key, the last in the order of the files."""
    return df.groupBy(key).agg(*[F.max_by(v, "_ord").alias(v) for v in values])


def read_scores(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """name, len, total, struct, prob of an alignment-score listing: the rows between its first and second block of comments."""
    lines = spark.read.text(path).select(F.col("value").alias("line"), _ord().alias("_ord"))
    # the rows follow the first comment line and end at the next comment line after any row: linear, and in any number of tasks
    seen = lines.where("line like '#%'").select("_ord")
    body = lines.where("line not like '#%' and trim(line) <> ''")
    spans = seen.groupBy(F.col("_ord.file").alias("file")).agg(F.min("_ord").alias("first"))  # a row for each file
    after = body.join(spans, F.col("_ord.file") == F.col("file")).where(F.col("_ord") > F.col("first"))
    begin = after.groupBy("file").agg(F.min("_ord").alias("begin"))
    end = seen.join(begin, F.col("_ord.file") == F.col("file")).where(F.col("_ord") > F.col("begin")).groupBy("file").agg(F.min("_ord").alias("end"))
    rows = after.join(end, "file", "left").where(F.col("end").isNull() | (F.col("_ord") < F.col("end")))
    part = F.split(F.trim("line"), r"\s+")
    return rows.select(part.alias("p")).selectExpr("p[1] as name", "cast(p[2] as int) as len", "cast(p[3] as double) as total", "cast(p[4] as double) as struct", "cast(p[5] as double) as prob")


def read_alignments(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """q_name, t_name, q_seq, t_seq, fields map<string,string>, _ord: one row for each alignment of pairwise search reports.

    A report's context (query, parameters, alignment) is in the lines before, so a file is read by one task.
    """
    whole = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for text, file in zip(f["value"], f["file"], strict=True):
                rows = list(alignments(text.split("\n")))
                if rows:
                    yield pd.DataFrame({"q_name": [r["q_name"] for r in rows], "t_name": [r["t_name"] for r in rows], "q_seq": [r.get("q_seq") for r in rows], "t_seq": [r.get("t_seq") for r in rows], "fields": rows, "file": file, "row": range(len(rows))})

    schema = "q_name string, t_name string, q_seq string, t_seq string, fields map<string,string>, file string, row long"
    return whole.mapInPandas(run, schema).select("q_name", "t_name", "q_seq", "t_seq", "fields", F.struct("file", F.lit(0).cast("long").alias("block"), "row").alias("_ord"))


def alignments(lines: list[str]) -> Iterator[dict[str, str]]:
    """Alignments of a report: `>>>` opens a query, `>>` a target, `>--` another alignment of it, `>` a sequence of the pair, `;` a field."""
    query, target, found, side = None, None, None, None
    for line in lines:
        if line.startswith(">>>"):
            if found:
                yield found
            found, side = None, None
            name = line[3:].split(",")[0].split()
            query = name[0] if name and not line.startswith(">>><<<") else query
        elif line.startswith(">>"):
            if found:
                yield found
            target = (line[2:].split() or [""])[0]
            found, side = {"q_name": query, "t_name": target}, ""
        elif line.startswith(">--"):
            if found:
                yield found
            found, side = {"q_name": query, "t_name": target}, ""
        elif line.startswith(">") and found is not None:
            side = "q_" if side == "" else "t_"
            found[side + "seq"] = ""
        elif line.startswith(";") and found is not None:
            k, _, v = line[1:].partition(":")
            k = k.strip()
            found[k if k[:3] in ("sw_", "fa_") else side + k] = v.strip()
        elif found is not None and side:
            found[side + "seq"] += line.strip()
    if found:
        yield found


def read_genbank(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """id, name, description, seq, features array<struct<type,qualifiers,start,end,strand>>: records of flat files, cut at `//`."""
    raw = spark.read.option("lineSep", "\n//").text(path).where("value like '%LOCUS%'").select("value", _ord().alias("_ord"))
    feature = "array<struct<type:string,qualifiers:map<string,array<string>>,start:int,end:int,strand:int>>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([flat_record(v) for v in f["value"]]).assign(_ord=f["_ord"].to_list())

    return raw.mapInPandas(run, f"id string, name string, description string, seq string, features {feature}, _ord struct<file:string,block:long,row:long>")


def flat_record(text: str) -> dict:
    """One record of a flat file."""
    import re

    out = {"id": "", "name": "", "description": "", "seq": "", "features": []}
    part, feature, value = "", None, None
    for line in text.split("\n"):
        word = line[:12].strip()
        if line[:1].strip():
            part = word.split()[0] if word else ""
        if part == "LOCUS" and word == "LOCUS":
            out["name"] = line[12:].split()[0]
        elif part == "DEFINITION":
            out["description"] = f"{out['description']} {line[12:].strip()}".strip()
        elif part == "VERSION" or (part == "ACCESSION" and not out["id"]):
            out["id"] = (line[12:].split() or [""])[0]
        elif part == "ORIGIN" and word != "ORIGIN":
            out["seq"] += re.sub(r"[^A-Za-z]", "", line).upper()
        elif part == "FEATURES" and line.startswith("     "):
            if line[5:6].strip():
                place = line[21:].strip()
                ends = [int(x) for x in re.findall(r"\d+", place)] or [1, 0]
                feature = {"type": line[5:21].strip(), "qualifiers": {}, "start": min(ends) - 1, "end": max(ends), "strand": -1 if "complement" in place else 1}
                out["features"].append(feature)
                value = None
            elif feature is not None and line[21:22] == "/":
                k, _, v = line[22:].partition("=")
                value = feature["qualifiers"].setdefault(k.strip(), [])
                value.append(v.strip().strip('"'))
            elif value:
                value[-1] = f"{value[-1]} {line[21:].strip()}".strip('"')
    out["description"] = out["description"].rstrip(".")
    return out


def read_newick(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, tree: one row for each tree of a file."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.explode(F.split("value", ";")).alias("tree"))
    return whole.select("file", F.concat(F.trim(F.regexp_replace("tree", r"\s*\n\s*", "")), F.lit(";")).alias("tree")).where("tree <> ';'")


def read_run_lengths(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """name, rle: a headerless table, or one JSON object of name to string."""
    if str(path).endswith((".json", ".json.gz", ".json.bz2")):
        whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
        return whole.select(F.explode("m").alias("name", "rle"))
    return read_table(spark, path, header=False, names=["name", "rle"])


def read_barcodes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return read_table(spark, path).select("sample", "barcode")


def with_order(df: DataFrame, *columns: str) -> DataFrame:
    """df with `_ord` from columns that order it."""
    return df.withColumn("_ord", F.struct(*columns))


def first_position(df: DataFrame, name: str) -> DataFrame:
    """Distinct names with the place of their first appearance, from 0."""
    seen = df.groupBy(name).agg(F.min("_ord").alias("_ord"))
    return seen.select(name, (F.row_number().over(Window.orderBy("_ord")) - 1).alias("position"))
