"""Functions of sequence strings, as native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Nucleotide codes and their complements, position by position; the bases behind each ambiguity code; gaps.
CODES, COMPLEMENTS = "ACGTMKRYWSBVDHN", "TGCAKMYRWSVBHDN"
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "M": "AC", "K": "GT", "S": "CG", "W": "AT", "H": "ACT", "B": "CGT", "V": "ACG", "D": "AGT", "N": "ACGT"}
GAP, RUN_GAP = "-", "="
#: Run lengths are written as characters from this code on; the largest length that fits.
RUN_OFFSET, LONGEST_RUN = 48, 78


def characters(s: Column) -> Column:
    """The characters of a string; none for an empty one."""
    return F.when(F.length(s) == 0, F.array().cast("array<string>")).otherwise(F.split(s, ""))


def without_gap(s: Column) -> Column:
    """The sequence; an error where it has a gap, which run-length encoding can't take."""
    return F.when(s.contains(GAP), F.raise_error(F.concat(F.lit("gap in a sequence to encode: "), s)).cast("string")).otherwise(s)


def run_lengths(s: Column) -> Column:
    """Lengths of the runs of equal characters."""
    return F.transform(F.regexp_extract_all(F.upper(s), F.lit(r"(?s)((.)\2*)"), F.lit(1)), F.length)


def collapse_runs(s: Column) -> Column:
    """The sequence, in capitals, with each run of equal characters as one."""
    return F.regexp_replace(F.upper(s), r"(?s)(.)\1+", "$1")


def expand_runs(s: Column, counts: Column) -> Column:
    """Inverse of collapse_runs: each character as often as its count says. A gap or run gap becomes `-` and uses no count."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("i"))

    def step(a, c):
        gap = F.struct(F.concat(a["out"], F.lit(GAP)).alias("out"), a["i"].alias("i"))
        base = F.struct(F.concat(a["out"], F.repeat(c, counts[a["i"]])).alias("out"), (a["i"] + 1).alias("i"))
        return F.when(c.isin(GAP, RUN_GAP), gap).otherwise(base)

    return F.aggregate(characters(s), start, step, lambda a: a["out"])


def encode_lengths(counts: Column) -> Column:
    """Run lengths as a string, one character each; a length over LONGEST_RUN is an error."""
    one = lambda n: F.when(n.between(0, LONGEST_RUN), F.char(n + RUN_OFFSET)).otherwise(F.raise_error(F.concat(F.lit("run length out of range: "), n.cast("string"))).cast("string"))
    return F.array_join(F.transform(counts, one), "")


def decode_lengths(s: Column) -> Column:
    """Inverse of encode_lengths."""
    return F.transform(characters(s), lambda c: F.ascii(c) - RUN_OFFSET)


def complement(s: Column) -> Column:
    return F.translate(F.upper(s), CODES, COMPLEMENTS)


def reverse_complement(s: Column) -> Column:
    """Reverse complement, ambiguity codes included; other characters stay."""
    return F.reverse(complement(s))


def reverse_lengths(s: Column) -> Column:
    """The run lengths of the reversed sequence."""
    return F.reverse(s)


def looks_like_lengths(s: Column) -> Column:
    """Whether a string is run lengths rather than bases: more than half of it are digits."""
    return F.length(F.regexp_replace(s, "[^0-9]", "")) > 0.5 * F.length(s)


def between(s: Column, start: Column, stop: Column) -> Column:
    """s from start (from 0) up to stop; a null stop means to the end."""
    return F.when(stop.isNull(), F.substr(s, start + 1)).otherwise(F.substr(s, start + 1, F.greatest(stop - start, F.lit(0))))


def count_ambiguous(s: Column) -> Column:
    """Characters that aren't A, C, G or T (capitals)."""
    return F.length(F.regexp_replace(s, "[ACGT]", ""))


def sequence_key(s: Column) -> Column:
    """Digest by which equal sequences meet, whatever their case."""
    return F.sha1(F.upper(s).cast("binary"))


def phred(quality: Column, offset: int = 33) -> Column:
    return F.transform(characters(quality), lambda c: F.ascii(c) - offset)


def mean_phred(quality: Column, offset: int = 33) -> Column:
    """Mean quality; null for an empty string."""
    total = F.aggregate(phred(quality, offset), F.lit(0), lambda a, x: a + x)
    return F.when(F.length(quality) > 0, total / F.length(quality))


#: SQL functions by name: (parameters, result, expression).
SQL_FUNCTIONS = {
    "seq_collapse_runs": ("s string", "string", "regexp_replace(upper(s), '(?s)(.)\\\\1+', '$1')"),
    "seq_run_lengths": ("s string", "array<int>", "transform(regexp_extract_all(upper(s), '(?s)((.)\\\\2*)', 1), x -> length(x))"),
    "seq_encode_lengths": ("counts array<int>", "string", f"array_join(transform(counts, n -> char(n + {RUN_OFFSET})), '')"),
    "seq_decode_lengths": ("s string", "array<int>", f"if(s = '', array(), transform(split(s, ''), c -> ascii(c) - {RUN_OFFSET}))"),
    "seq_reverse_complement": ("s string", "string", f"reverse(translate(upper(s), '{CODES}', '{COMPLEMENTS}'))"),
    "seq_count_ambiguous": ("s string", "int", "length(regexp_replace(s, '[ACGT]', ''))"),
    "seq_key": ("s string", "string", "sha1(upper(s))"),
}


def register(spark: SparkSession) -> None:
    """Make the functions callable from SQL, as native expressions."""
    for name, (parameters, result, body) in SQL_FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {name}({parameters}) returns {result} return {body}")
