"""Sequence expressions: every function takes and returns Columns and stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The standard genetic code; codon index 16a + 4b + c with A 0, C 1, G 2, T 3. Fixed values.
GENETIC_CODE = "KNKNTTTTRSRSIIMIQHQHPPPPRRRRLLLLEDEDAAAAGGGGVVVV*Y*YSSSS*CWCLFLF"


#: Characters of a chunk in which k-mers are looked up, and of one that is compared base by base.
CHUNK = 128
SHORT = 24
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def upper_ascii(s: Column) -> Column:
    """a-z to A-Z only: a character stays one character."""
    return F.translate(s, LOWER, UPPER)


def let(value: Column, body) -> Column:
    """body(value) with the value computed once per row. Inside a lambda Spark would compute an expression again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def dna(text: Column) -> Column:
    """The A, C, G and T of a text, upper-cased."""
    return F.regexp_replace(F.upper(text), "[^ACGT]+", "")


def reverse_complement(s: Column) -> Column:
    """Anything but A, C, G, T (lower case too) becomes N."""
    return F.reverse(F.translate(F.regexp_replace(s, "[^ACGT]", "N"), "ACGT", "TGCA"))


def fragments(s: Column, width: int) -> Column:
    """array<struct<frag, seq>> of tumbling pieces; an empty sequence has one empty piece."""
    last = F.greatest(F.ceil(F.length(s) / width) - 1, F.lit(0)).cast("int")
    return let(s, lambda t: F.transform(F.sequence(F.lit(0), last), lambda f: F.struct(f.alias("frag"), F.substr(t, f * width + 1, F.lit(width)).alias("seq"))))


def pieces(t: Column, step: int, size: int) -> Column:
    """The substrings of at most `size` characters that start every `step` characters, in time in proportion to the text. A substring is found by walking from the start
    of its string, so a text is first cut into runs by one pass of a regular expression, and pieces are looked up within a run. size - step may not exceed 32 steps."""
    run = 32 * step

    def inside(runs: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            more = F.coalesce(F.substr(F.get(runs, i + 1), F.lit(1), F.lit(size - step)), F.lit("")) if size > step else F.lit("")
            starts = F.sequence(F.lit(0), F.floor((F.length(x) - 1) / step).cast("int"))
            return let(F.concat(x, more), lambda y: F.transform(starts, lambda c: F.substr(y, c * step + 1, F.lit(size))))

        return F.flatten(F.transform(runs, one))

    return let(F.regexp_extract_all(t, F.lit(f"(?s).{{1,{run}}}"), F.lit(0)), inside)


def in_chunks(t: Column, step: int, size: int, body) -> Column:
    """body(piece) of all pieces as one array."""
    return F.flatten(F.transform(pieces(t, step, size), body))


def kmers(s: Column, k: int) -> Column:
    """All k-mers in order; none for a sequence shorter than k. Pieces overlap by k - 1, so each k-mer is found in the piece that it starts in."""
    none = F.array().cast("array<string>")
    step = max(CHUNK, k // 16)
    inside = lambda p: F.when(F.length(p) >= k, F.transform(F.sequence(F.lit(1), F.length(p) - (k - 1)), lambda i: F.substr(p, i, F.lit(k)))).otherwise(none)
    return in_chunks(s, step, step + k - 1, inside)


def canonical(kmer: Column) -> Column:
    """The pair of a k-mer and its reverse complement, smaller first."""
    rc = reverse_complement(kmer)
    return F.struct(F.least(kmer, rc).alias("a"), F.greatest(kmer, rc).alias("b"))


def canonical_pairs(s: Column, k: int) -> Column:
    """Distinct canonical pairs of a sequence. The strand is reversed once, not for each k-mer, and the smaller k-mers are made
    distinct as strings, which Spark hashes; structs it would compare each with each."""
    opposite = F.reverse(kmers(reverse_complement(s), k))  # the reverse complement of each k-mer, in the k-mers' order
    smaller = F.array_distinct(F.zip_with(kmers(s, k), opposite, lambda x, y: F.least(x, y)))
    return F.transform(smaller, lambda x: F.struct(x.alias("a"), F.reverse(F.translate(x, "ACGTN", "TGCAN")).alias("b")))


def residue(codon: Column) -> Column:
    """The amino acid of a codon; X if a base is unknown."""
    index = F.conv(F.translate(codon, "ACGT", "0123"), 4, 10).cast("int")
    return F.when(F.length(F.translate(codon, "ACGT", "")) == 0, F.substr(F.lit(GENETIC_CODE), index + 1, F.lit(1))).otherwise("X")


def translate_codons(s: Column) -> Column:
    """Whole codons from the start; one or two bases left over are dropped. One pass cuts the codons, and each is looked up by its bases' numbers."""
    digits = F.translate(F.regexp_replace(s, "[^ACGT]", "N"), "ACGTN", "01234")
    code = F.array(*map(F.lit, GENETIC_CODE))

    def residue_of(c: Column) -> Column:
        index = F.ascii(c) * 16 + F.ascii(F.substr(c, F.lit(2), F.lit(1))) * 4 + F.ascii(F.substr(c, F.lit(3), F.lit(1))) - 21 * ord("0")
        return F.when(F.contains(c, F.lit("4")), "X").otherwise(F.get(code, index))

    return F.array_join(F.transform(F.regexp_extract_all(digits, F.lit("..."), F.lit(0)), residue_of), "")


def six_frames(s: Column) -> Column:
    """array<struct<frame, protein>>: three offsets forward, three on the reverse complement."""
    rc = reverse_complement(s)
    return F.array(*(F.struct(F.lit(f).alias("frame"), translate_codons(F.substr(s if f < 3 else rc, F.lit(f % 3 + 1), F.length(s))).alias("protein")) for f in range(6)))


def codon_symbols(s: Column, legacy: bool = False) -> Column:
    """Packed codons: bases other than ACGT are skipped, the last codon may be short, and a symbol is the smaller of the
    base-4 number forwards and backwards, plus 1. legacy: the 1 is added to the backward number only."""
    clean = F.translate(F.regexp_replace(s, "[^ACGT]", ""), "ACTG", "0123")

    def symbol(digits: Column) -> Column:
        forward, backward = F.conv(digits, 4, 10).cast("long"), F.conv(F.reverse(digits), 4, 10).cast("long")
        return F.when(forward < backward, forward).otherwise(backward + 1) if legacy else F.least(forward, backward) + 1

    return F.transform(F.regexp_extract_all(clean, F.lit(".{1,3}"), F.lit(0)), symbol)


def char_code(ch: Column) -> Column:
    """A 4, C 5, G 6, T 7, N 3, any other 2."""
    return F.when(ch == "A", 4).when(ch == "C", 5).when(ch == "G", 6).when(ch == "T", 7).when(ch == "N", 3).otherwise(2)


def chars(s: Column) -> Column:
    """The characters of a string."""
    return F.regexp_extract_all(s, F.lit("(?s)."), F.lit(0))


def not_acgt(s: Column) -> Column:
    return F.length(F.regexp_replace(s, "[ACGT]", ""))


def split_names(s: Column, delimiter: str) -> Column:
    """Tokens of a string; an empty last token is dropped."""
    parts = F.split(s, delimiter)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def unique_names(names: Column) -> Column:
    """Names with their level appended from level 1 on, so that equal names of different levels differ."""
    return F.transform(names, lambda x, i: F.when(i > 0, F.concat(x, i.cast("string"))).otherwise(x))


def binomial_bound(i: Column, r: float = 0.01) -> Column:
    """The lower bound trunc(i p - 1.65 sqrt(p (1 - p) i)) with p = 1 + r^2 - 5 r / 3."""
    p = 1 + r * r - 5 * r / 3
    return (i * p - F.sqrt(F.lit(p * (1 - p)) * i) * 1.65).cast("int")


def cluster_count(total: Column, per: int, low: int, high: int) -> Column:
    return F.least(F.greatest(F.floor(total / per), F.lit(low)), F.lit(high)).cast("long")


def differing(x: Column, y: Column) -> Column:
    """The number of places at which two sequences differ, up to the end of the shorter one. Equal pieces are told as a whole."""
    apart = lambda p: F.aggregate(F.sequence(F.lit(1), F.least(F.length(p["x"]), F.length(p["y"]))), F.lit(0), lambda n, i: n + (F.substr(p["x"], i, F.lit(1)) != F.substr(p["y"], i, F.lit(1))).cast("int"))
    one = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    both = F.zip_with(pieces(x, SHORT, SHORT), pieces(y, SHORT, SHORT), one)
    wrong = lambda p: F.when(p["x"].isNull() | p["y"].isNull() | (p["x"] == p["y"]), 0).otherwise(apart(p))
    return F.coalesce(F.aggregate(both, F.lit(0), lambda n, p: n + wrong(p)), F.lit(0))


def overlap(a: Column, b: Column, shift: Column) -> Column:
    """struct<match, mismatch> of two sequences where b starts shift bases into a."""
    both = F.struct(F.substr(a, shift + 1, F.length(a)).alias("x"), b.alias("y"))
    n = lambda p: F.least(F.length(p["x"]), F.length(p["y"]))
    return let(both, lambda p: let(differing(p["x"], p["y"]), lambda w: F.struct((n(p) - w).alias("match"), w.alias("mismatch"))))


def genome_of(sid: Column) -> Column:
    return F.shiftright(sid, 16)


def packed_id(genome: Column, gene: Column) -> Column:
    return F.shiftleft(genome, 16).bitwiseOR(gene)
