"""Functions of aligned pairs: errors, positions, coverage, differences."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from seqlake.functions.sequence import GAP, IUPAC, RUN_GAP, characters

ERROR_ITEM = "array<struct<i:int,ref:string,query:string>>"


NONE = (GAP, RUN_GAP)


def _run(s: str, at: int) -> int:
    """Length of the run at a place; none at a gap."""
    if at >= len(s) or s[at] in (GAP, RUN_GAP):
        return 0
    n = 1
    while at + n < len(s) and s[at + n] == s[at]:
        n += 1
    return n


def error_items(ref: str, query: str) -> list[dict]:
    """Aligned pieces of reference and query, run by run; i counts reference bases before the piece."""
    lead = len(ref) - len(ref.lstrip(GAP))
    ref, query = ref.strip(GAP), query[lead:]
    n, at, bases, out = min(len(ref), len(query)), 0, 0, []
    while at < n:
        step = max(_run(ref, at), _run(query, at))
        if not step:
            raise ValueError("both sequences have a gap at one place")
        piece = ref[at : at + step]
        out.append({"i": bases, "ref": piece, "query": query[at : at + step]})
        bases += sum(c not in (GAP, RUN_GAP) for c in piece)
        at += step
    return out


def itemize_errors(ref: Column | str, query: Column | str) -> Column:
    """Array of {i, ref, query}, by an Arrow UDF; null where a sequence is null."""

    @F.pandas_udf(ERROR_ITEM)
    def of(ref: pd.Series, query: pd.Series) -> pd.Series:
        return pd.Series([None if r is None or q is None else error_items(r, q) for r, q in zip(ref, query, strict=True)])

    return of(ref, query)


def error_category(ref: Column, query: Column) -> Column:
    """equal, indel, snp, homoindel or compound."""
    bases = lambda s: F.array_sort(F.array_distinct(characters(F.regexp_replace(s, RUN_GAP, ""))))
    return (
        F.when(ref == query, "equal")
        .when(ref.contains(GAP) | query.contains(GAP), "indel")
        .when((F.length(ref) == 1) & (F.length(query) == 1), "snp")
        .when(bases(ref) == bases(query), "homoindel")
        .otherwise("compound")
    )


def error_counts(ref: str, query: str) -> tuple[int, int, int, int, int, int, int]:
    """Pieces of error_items, and of them snp, indel, homoindel, compound (as error_category has it) and all but equal ones;
    the reference's bases."""
    ref, query = ref.strip(GAP), query[len(ref) - len(ref.lstrip(GAP)) :]
    most, at, n, snp, indel, homoindel, compound, bases = min(len(ref), len(query)), 0, 0, 0, 0, 0, 0, 0
    r_next, q_next = ref[1:] + "\0", query[1:] + "\0"
    while at < most:
        a, b = ref[at], query[at]
        n += 1
        if a != r_next[at] and b != q_next[at]:  # a piece of single letters, as most are
            at += 1
            if a not in NONE:
                bases += 1
            elif b in NONE:
                raise ValueError("both sequences have a gap at one place")
            if a != b:
                if a == GAP or b == GAP:
                    indel += 1
                else:
                    snp += 1
            continue
        step = max(_run(ref, at), _run(query, at))
        if not step:
            raise ValueError("both sequences have a gap at one place")
        r, q = ref[at : at + step], query[at : at + step]
        at += step
        bases += len(r) - r.count(GAP) - r.count(RUN_GAP)
        if r == q:
            continue
        if GAP in r or GAP in q:
            indel += 1
        elif len(r) == 1 and len(q) == 1:
            snp += 1
        elif set(r) - {RUN_GAP} == set(q) - {RUN_GAP}:
            homoindel += 1
        else:
            compound += 1
    return n, snp, indel, homoindel, compound, snp + indel + homoindel + compound, bases


def tally_errors(ref: Column | str, query: Column | str) -> Column:
    """struct(pieces, snp, indel, homoindel, compound, total, length) of error_counts, by an Arrow UDF; zeros where a sequence is null."""
    names = ["pieces", "snp", "indel", "homoindel", "compound", "total", "length"]

    @F.pandas_udf(", ".join(f"{n} long" for n in names))
    def of(ref: pd.Series, query: pd.Series) -> pd.DataFrame:
        rows = [(0,) * 7 if r is None or q is None else error_counts(r, q) for r, q in zip(ref, query, strict=True)]
        return pd.DataFrame(rows, columns=names)

    return of(ref, query)


def expanded_pair(s1: str, c1: list[int], s2: str, c2: list[int]) -> tuple[str, str]:
    """Run-collapsed aligned pair back to bases: a gap is as long as the other side's run, the shorter run is filled with `=`."""
    out1, out2, i, j = [], [], 0, 0
    for a, b in zip(s1, s2, strict=True):
        if a == GAP and b == GAP:
            raise ValueError("both sequences have a gap at one place")
        m = n = 0
        if a != GAP:
            m, i = c1[i], i + 1
        if b != GAP:
            n, j = c2[j], j + 1
        k = max(m, n)
        out1.append(GAP * k if a == GAP else a * m + RUN_GAP * (k - m))
        out2.append(GAP * k if b == GAP else b * n + RUN_GAP * (k - n))
    return "".join(out1), "".join(out2)


def expand_alignment(s1: Column | str, c1: Column | str, s2: Column | str, c2: Column | str) -> Column:
    """struct(first, second): both sides of a run-collapsed alignment, expanded by an Arrow UDF."""

    @F.pandas_udf("struct<first:string,second:string>")
    def of(s1: pd.Series, c1: pd.Series, s2: pd.Series, c2: pd.Series) -> pd.DataFrame:
        rows = [(None, None) if any(x is None for x in r) else expanded_pair(r[0], list(r[1]), r[2], list(r[3])) for r in zip(s1, c1, s2, c2, strict=True)]
        return pd.DataFrame(rows, columns=["first", "second"])

    return of(s1, c1, s2, c2)


def coverage_percent(start: Column, end: Column, length: Column) -> Column:
    """Covered part of the query in percent, both ends counted."""
    return (end - start + 1) / length * 100


def coverage_open(start: Column, stop: Column, length: Column) -> Column:
    """Covered fraction of half-open positions."""
    return (stop - start) / length


def coverage_fraction(start: Column, end: Column, length: Column) -> Column:
    """Covered fraction of the alignment's length, both ends counted."""
    return (end - start + 1) / length


def primer_position(side: str, include: bool, start: Column, stop: Column, frame: Column) -> Column:
    """Where a trimmed read begins (side left) or ends (side right), from an alignment's 1-based start and stop."""
    if side == "left":
        return F.when(F.coalesce(frame, F.lit("f")) == "f", start - 1 if include else stop)
    return F.when(F.coalesce(frame, F.lit("f")) == "f", stop if include else start - 1).otherwise(start if include else stop - 1)


#: Code -> string of all codes that share a base with it.
ALIKE = {c: "".join(sorted(d for d, e in IUPAC.items() if set(b) & set(e))) for c, b in IUPAC.items()}


def shown_difference(query: Column, target: Column) -> Column:
    """struct(q, t): where the two agree (codes in capitals agree if they share a base) q has `.`, else both are in small
    letters. As far as the shorter of the two goes."""
    alike = F.create_map(*[F.lit(x) for kv in ALIKE.items() for x in kv])
    same = lambda a, b: (a == b) | F.coalesce(F.contains(F.try_element_at(alike, a), b), F.lit(False))
    n = F.least(F.length(query), F.length(target))
    q, t = (characters(F.substr(x, F.lit(1), n)) for x in (query, target))
    pick = lambda f: F.array_join(F.zip_with(q, t, f), "")
    return F.struct(pick(lambda a, b: F.when(same(a, b), ".").otherwise(F.lower(a))).alias("q"), pick(lambda a, b: F.when(same(a, b), b).otherwise(F.lower(b))).alias("t"))


def barcode_matches(seqs: Iterator[str], barcodes: dict[str, str], window: int) -> list[tuple]:
    """(sample, start, kind) by read: an exact hit in the first bases, else the one barcode that is clearly closest."""
    from difflib import SequenceMatcher

    out = []
    for s in seqs:
        head = (s or "")[:window]
        found = next(((name, head.find(code), "exact") for name, code in barcodes.items() if code and code in head), None)
        if found is None and head:
            scored = []
            for name, code in barcodes.items():
                m = SequenceMatcher(None, head, code, autojunk=False)
                b = m.find_longest_match(0, len(head), 0, len(code))
                scored.append((m.ratio(), name, code, b.b, b.a))
            scored.sort(key=lambda x: -x[0])
            if scored:
                r, name, code, at, first = scored[0]
                second = scored[1][0] if len(scored) > 1 else 0.0
                near = SequenceMatcher(None, head[max(0, first - at) : max(0, first - at) + len(code)], code, autojunk=False).ratio()
                if r - second >= 3 / (window + len(code)) and near >= (len(code) - 1) / len(code):
                    found = name, at, "near"
        out.append(found or (None, None, None))
    return out


def match_barcode(barcodes: dict[str, str], window: int):
    """Arrow UDF from reads to struct(sample, bc_start, kind). barcodes: a sample sheet, bounded by the plate."""

    @F.pandas_udf("struct<sample:string,bc_start:int,kind:string>")
    def of(seq: pd.Series) -> pd.DataFrame:
        found = pd.DataFrame(barcode_matches(seq, barcodes, window), columns=["sample", "bc_start", "kind"])
        return found.astype({"bc_start": "Int32"})

    return of
