"""Column expressions over nucleotide strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bases of each ambiguity letter (U is an older spelling of R).
IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T", "N": "ACGT", "Y": "CT", "R": "AG", "U": "AG",
    "W": "AT", "S": "CG", "H": "ACT", "D": "AGT", "B": "CGT", "V": "ACG", "K": "GT", "M": "AC",
}

# Adapter starts looked for at the head of a read and inside it.
ADAPTER_HEAD = [
    "G?ATCGGAAGAG", "CGGTTCAGCAGGAATG", "CAGCAGGAATGCCGAG", "G?TTTGTAAGAG[CT]T[CT]GTA",
    "G?TTTGTAAGAG[CT]GGTT[CT]AG[CT]", "[TC]AG[TC]AGGAATG[CT][CT]GAG",
    "[CT]GGTT[CT]AG[CT]AGGAATG[CT][CT]", "T[CT]GGTT[CT]AG[CT]AGGAATG[CT][CT]",
]
ADAPTER_INSIDE = [
    "GATCGGAAGAG", "CGGTTCAGCAGGAATG", "CAGCAGGAATGCCGAG", "GTTTGTAAGAG[CT]T[CT]GTA",
    "GTTTGTAAGAG[CT]GGTT[CT]AG[CT]", "[TC]AG[TC]AGGAATG[CT][CT]GAG",
    "[CT]GGTT[CT]AG[CT]AGGAATG[CT][CT]", "T[CT]GGTT[CT]AG[CT]AGGAATG[CT][CT]",
]


def iupac_regex(pattern: str) -> str:
    """Regular expression of an ambiguity pattern, e.g. GCH -> GC[ACT]."""
    parts = [IUPAC[c] for c in pattern.upper()]
    return "".join(p if len(p) == 1 else f"[{p}]" for p in parts)


def iupac_revcomp(pattern: str) -> str:
    pairs = str.maketrans("ACGTUYRWSKMBDHVN", "TGCAYRYWSMKVHDBN")
    return pattern.upper().translate(pairs)[::-1]


def complement(seq: Column) -> Column:
    return F.translate(seq, "ACGTacgt", "TGCAtgca")


def revcomp(seq: Column) -> Column:
    return F.reverse(complement(seq))


def toggle_case(seq: Column) -> Column:
    upper = "ACGTN"
    return F.translate(seq, upper + upper.lower(), upper.lower() + upper)


def quality(char: Column, offset: int = 33) -> Column:
    return F.ascii(char) - F.lit(offset)


def bisulfite_convert(seq: Column, reverse_strand: bool = False, keep_cpg: bool = True) -> Column:
    """C->T (or G->A); with keep_cpg the C (or G) of a CpG becomes Y (or R)."""
    if reverse_strand:
        marked = F.regexp_replace(seq, "CG", "CR") if keep_cpg else seq
        return F.translate(marked, "G", "A")
    marked = F.regexp_replace(seq, "CG", "YG") if keep_cpg else seq
    return F.translate(marked, "C", "T")


def mask_repeats(seq: Column) -> Column:
    """Lower-case (repeat) bases to N."""
    return F.regexp_replace(seq, "[a-z]", "N")


def count_of(seq: Column, base: str) -> Column:
    return F.length(seq) - F.length(F.replace(seq, F.lit(base), F.lit("")))


def contaminant_class(seq: Column, max_a: float = 0.9) -> Column:
    """adapter (leads), adapter_trim (inside), poly_a, clean."""
    lead = seq.rlike("(?i)^(" + "|".join(ADAPTER_HEAD) + ")")
    inside = seq.rlike("(?i)(" + "|".join(ADAPTER_INSIDE) + ")")
    share = count_of(F.upper(seq), "A") / F.nullif(F.length(seq), F.lit(0))
    return F.when(lead, "adapter").when(inside, "adapter_trim").when(share > max_a, "poly_a").otherwise("clean")


def adapter_trim_length(seq: Column) -> Column:
    """Bases in front of an inside adapter, by the first pattern of the list that matches."""
    out = None
    for pat in ADAPTER_INSIDE:
        at = F.regexp_instr(seq, F.lit(f"(?i){pat}"))
        out = F.when(at > 0, at - 1) if out is None else out.when(at > 0, at - 1)
    return out


def positions_of(seq: Column, n: int = 1) -> Column:
    """Array of 1-based start positions of all n-long pieces (empty when too short)."""
    last = F.length(seq) - (n - 1)
    return F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))


def pattern_positions(seq: Column, regex: str, n: int) -> Column:
    """1-based starts of every (also overlapping) match of an n-long pattern."""
    return F.filter(positions_of(seq, n), lambda i: F.substring(seq, i, F.lit(n)).rlike(f"^{regex}$"))


def hamming(a: Column, b: Column) -> Column:
    """Number of differing characters of two equally long strings."""
    chars = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x.eqNullSafe(y), 0).otherwise(1))
    return F.aggregate(chars, F.lit(0), lambda acc, x: acc + x)


def cytosine_classes(prev: Column, base: Column, nxt: Column) -> dict[str, Column]:
    """Boolean class tests at a reference base; the neighbour may be NULL at a sequence end."""
    is_c, prev_g = base == "C", F.coalesce(prev == "G", F.lit(False))
    next_g = F.coalesce(nxt == "G", F.lit(False))
    has_prev, has_next = prev.isNotNull(), nxt.isNotNull()
    return {
        "cpg": is_c & next_g,
        "gch": is_c & prev_g & ~next_g,
        "gcg": is_c & prev_g & next_g & has_next,
        "hcg": is_c & has_prev & ~prev_g & next_g,
        "hch": is_c & has_prev & ~prev_g & ~next_g,
    }


def context_class(base: Column, next1: Column, next2: Column) -> Column:
    """CG, CHG, CHH, or C when the context is not known; NULL for other bases."""
    return (
        F.when(base != "C", F.lit(None).cast("string"))
        .when(next1 == "G", "CG")
        .when(next1.isNull() | next2.isNull(), "C")
        .when(next2 == "G", "CHG")
        .otherwise("CHH")
    )


# Fixed values: (1-based position, bases, weight) of the oriented binding motif.
BINDING_MOTIF = [(5, "CA", 2), (9, "AG", 2), (15, "CA", 2)]


def strand_by_evidence(seq: Column, marks=tuple(BINDING_MOTIF), margin: int = 4) -> Column:
    """+ or - by which strand carries more motif weight, `.` inside the margin."""
    score = lambda s: sum(F.when(F.substring(s, p, len(b)) == b, w).otherwise(0) for p, b, w in marks)
    diff = score(seq) - score(revcomp(seq))
    return F.when(diff >= margin, "+").when(diff <= -margin, "-").otherwise(".")
