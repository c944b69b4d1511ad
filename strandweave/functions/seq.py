"""Column functions on sequences, signed paths, headers and numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def reverse_complement(seq: Column) -> Column:
    """Reverse complement of upper-case DNA; ``.`` stays, any other character becomes N."""
    known = F.regexp_replace(seq, "[^ACGT.]", "N")
    return F.reverse(F.translate(known, "ACGT", "TGCA"))


def canonical(kmer: Column) -> Column:
    """The lesser of a k-mer and its reverse complement. A<C<G<T as bytes, so text order is the
    order of 2-bit codes."""
    return F.least(kmer, reverse_complement(kmer))


def dna_letters(text: Column) -> Column:
    """The letters ACGT of a text, in upper case (filtered first: upper() may change others)."""
    return F.upper(F.regexp_replace(text, "[^ACGTacgt]", ""))


def kmers(seq: Column, k: int) -> Column:
    """Array of all k-mers in order; empty for shorter sequences (sequence() would count down).
    Letters are single bytes and cut out of the bytes: cutting a text counts from its start each
    time. For sequences of any length use ``operators.kmers.explode_kmers``."""
    data, n = seq.cast("binary"), F.octet_length(seq)
    made = F.transform(F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1))), lambda i: F.substr(data, i, F.lit(k)).cast("string"))
    return F.when(n >= k, made).otherwise(F.array().cast("array<string>"))


def encode_2bit(kmer: Column) -> Column:
    """2-bit code (A=0, C=1, G=2, T=3) of a k-mer of up to 31 bases; null with other letters."""
    base4 = F.conv(F.translate(F.upper(kmer), "ACGT", "0123"), 4, 10).cast("bigint")
    return F.when(F.upper(kmer).rlike("^[ACGT]{1,31}$"), base4)


def reverse_path(path: Column) -> Column:
    """The same path on the other strand: reversed and negated."""
    return F.transform(F.reverse(path), lambda x: -x)


def signed_text(path: Column) -> Column:
    """``12+,7-`` for the signed unitig numbers 12, -7."""
    shown = F.transform(path, lambda x: F.concat(F.abs(x).cast("string"), F.when(x >= 0, "+").otherwise("-")))
    return F.array_join(shown, ",")


def signed_path(text: Column) -> Column:
    """Inverse of :func:`signed_text`."""
    return F.transform(
        F.filter(F.split(text, ","), lambda p: p != ""),
        lambda p: F.substr(p, F.lit(1), F.length(p) - 1).try_cast("int") * F.when(F.right(p, F.lit(1)) == "-", -1).otherwise(1),
    )


def first_token(header: Column) -> Column:
    """Sequence name: what stands before the first white space."""
    return F.regexp_extract(header, r"^(\S*)", 1)


def rest_of_header(header: Column) -> Column:
    return F.regexp_extract(header, r"^\S*\s+(.*)$", 1)


def clean_header(header: Column) -> Column:
    """White space runs become single blanks."""
    return F.regexp_replace(F.trim(header), r"\s+", " ")


def directive(header: Column, name: str) -> Column:
    """Weight that a header gives by ``<tool>_name=N`` (any case, a token of its own, whatever the
    tool's name is), 1 by default."""
    found = F.regexp_extract(F.lower(header), rf"(?:^|\s)[a-z]+_{name.lower()}=(\d{{1,9}})(?:\s|$)", 1)
    return F.coalesce(F.nullif(found, F.lit("")).try_cast("int"), F.lit(1))


def is_trusted(header: Column) -> Column:
    """``<tool>_trusted`` anywhere in the header, in any case."""
    return F.lower(header).rlike("[a-z]_trusted")


def is_ignored(header: Column) -> Column:
    return F.lower(header).rlike("[a-z]_ignore")


def depth_from_header(header: Column) -> Column:
    """Depth that a header states as ``depth=``, ``depth-`` or ``coverage=``; the number ends at
    a hyphen, an underscore or a blank. Null without one."""
    found = F.regexp_extract(header, r"(?:depth[=-]|coverage=)([^-_ ]+)", 1)
    return _try_double(found)


def _try_double(text: Column) -> Column:
    return F.when(text.rlike(r"^[0-9]+(\.[0-9]*)?$|^\.[0-9]+$"), text).cast("double")


def newick_label(seq_id: Column, filename: Column, name: Column, length: Column) -> Column:
    return F.concat_ws("__", seq_id.cast("string"), filename, name, F.concat(length.cast("string"), F.lit("_bp")))


def contig_label() -> Column:
    """Tree label of a contig row (seq_id, filename, contig_header, length)."""
    return newick_label(F.col("seq_id"), F.col("filename"), first_token(F.col("contig_header")), F.col("length"))


def contig_text(filename: Column, header: Column, length: Column) -> Column:
    """A contig for people: file, name, length, and in brackets what its header says beyond the
    default."""
    weight = lambda name: F.when(directive(header, f"{name}_weight") != 1, F.concat(F.lit(f"{name} weight = "), directive(header, f"{name}_weight")))
    extras = F.concat_ws(", ", F.when(is_trusted(header), "trusted"), F.when(is_ignored(header), "ignored"), weight("cluster"), weight("consensus"))
    shown = F.concat(filename, F.lit(" "), first_token(header), F.lit(" ("), length.cast("string"), F.lit(" bp)"))
    return F.when(extras == "", shown).otherwise(F.concat(shown, F.lit(" ["), extras, F.lit("]")))


def with_attribute(header: Column, attribute: str, needs: str | None = None) -> Column:
    """A header with an attribute added, unless it is there already or the text ``needs`` is not."""
    add = ~header.contains(attribute)
    if needs is not None:
        add = add & header.contains(needs)
    return F.when(add, F.concat(header, F.lit(f" {attribute}"))).otherwise(header)


def rotated(seq: Column, header: Column, seed: int = 0) -> Column:
    """A circular contig (``circular=true`` in any case) begun elsewhere, at a place that seed and
    header decide; others as they are."""
    n = F.length(seq)
    at = (F.pmod(F.xxhash64(F.lit(seed), header), F.greatest(n - 1, F.lit(1))) + 1).cast("int")
    turned = F.concat(F.substr(seq, at + 1, n - at), F.substr(seq, F.lit(1), at))
    return F.when(F.lower(header).contains("circular=true") & (n > 1), turned).otherwise(seq)


def rounded_div(a: Column, b: int) -> Column:
    """Whole-number quotient of non-negative numbers, halves up."""
    return F.floor((a + b // 2) / b).cast("bigint")


def parse_genome_size(text: Column) -> Column:
    """``5.5m``, ``47K`` or plain numbers as bases; null if it is none."""
    t = F.lower(F.trim(text))
    number = _try_double(F.regexp_extract(t, r"^([0-9.]+)[kmg]?$", 1))
    unit = F.right(t, F.lit(1))
    factor = F.when(unit == "k", 1e3).when(unit == "m", 1e6).when(unit == "g", 1e9).otherwise(1.0)
    return F.round(number * factor).cast("bigint")


def fixed(x: Column, decimals: int) -> Column:
    """A number with so many decimals, ties to the even digit."""
    return F.format_string(f"%.{decimals}f", F.bround(x.cast("double"), decimals))


def format_float(x: float) -> str:
    """Up to six decimals without trailing zeros."""
    return f"{x:.6f}".rstrip("0").rstrip(".")


def format_sigfigs(x: float, figures: int) -> str:
    """``figures`` significant figures; whole digits are never cut off, trailing zeros are."""
    if x == 0 or not math.isfinite(x):
        return "0" if x == 0 else str(x)
    decimals = max(0, figures - 1 - math.floor(math.log10(abs(x))))
    shown = f"{x:.{decimals}f}"
    return shown.rstrip("0").rstrip(".") if "." in shown else shown
