"""Bisulfite-aware genotype likelihoods as sums over read bases."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociframe.functions.sequence import context_class
from lociframe.operators.lookups import base_neighbours
from lociframe.operators.piles import BASES, STRANDS, base_sums, beside, by_tile, dealt_reads, place

# The ten diploid genotypes and the default rates.
GENOTYPES = ["AA", "AC", "AG", "AT", "CC", "CG", "CT", "GG", "GT", "TT"]
CONVERSION = 0.9975
OVER_CONVERSION = 0.0
REFERENCE_ERROR = 1e-6
HETEROZYGOSITY = 1e-3
KNOWN_HETEROZYGOSITY = 0.1
TI_TV = 2.0
COUNTS = ["c_plus", "t_plus", "c_minus", "t_minus", "n_plus", "n_minus", "known_plus", "known_minus"]
PARTNER = {"A": "G", "G": "A", "C": "T", "T": "C"}


def base_probability(allele: str, base: Column, error: Column, minus: Column, meth: Column | float,
                     conversion: float = CONVERSION, over: float = OVER_CONVERSION) -> Column:
    """P(observed base | allele): cytosines (guanines on minus reads) may have been converted."""
    m = meth if isinstance(meth, Column) else F.lit(meth)
    kept = (1 - m) * (1 - conversion) + m * (1 - over)
    turned = (1 - m) * conversion + m * over
    miss = error / 3.0
    plain = F.when(base == allele, 1 - error).otherwise(miss)
    if allele in "CG":
        strand_ok = minus if allele == "G" else ~minus
        product = "A" if allele == "G" else "T"
        special = F.when(base == allele, (1 - error) * kept).when(base == product, miss + turned).otherwise(miss)
        return F.when(strand_ok, special).otherwise(plain)
    return plain


def likelihood_columns(meth: Column | float, conversion: float, over: float) -> dict[str, Column]:
    """log10 likelihood of one base under each genotype (base, qual, strand columns)."""
    error = F.pow(F.lit(10.0), -F.col("qual") / 10.0)
    p = {a: base_probability(a, F.col("base"), error, F.col("strand") == "-", meth, conversion, over) for a in "ACGT"}
    return {g: F.log10(0.5 * p[g[0]] + 0.5 * p[g[1]]) for g in GENOTYPES}


def likelihood_terms(quals: np.ndarray, meth: float, conversion: float, over: float) -> np.ndarray:
    """`likelihood_columns` as a table: strand (+, -, neither, null) by base (A, C, G, T, other, null) by quality by genotype."""
    error = np.power(10.0, -quals / 10.0)
    kept, turned = (1 - meth) * (1 - conversion) + meth * (1 - over), (1 - meth) * conversion + meth * over

    def probability(allele: str, base: str | None, strand: str | None) -> np.ndarray:
        converts = allele in "CG" and strand is not None and (strand == "-") == (allele == "G")
        if base == allele:
            return (1 - error) * kept if converts else 1 - error
        return error / 3.0 + turned if converts and base == PARTNER[allele] else error / 3.0

    p = np.array([[[probability(a, b, s) for a in BASES] for b in [*BASES, "", None]] for s in [*STRANDS, "", None]])
    both = np.stack([0.5 * p[:, :, BASES.index(g[0])] + 0.5 * p[:, :, BASES.index(g[1])] for g in GENOTYPES], axis=-1)
    return np.where(both > 0, np.log10(np.where(both > 0, both, 1.0)), np.nan)


def conversion_terms(quals: np.ndarray) -> np.ndarray:
    """Ones for C and T on plus reads, G and A on minus reads, all and the known bases of either, in the form of `likelihood_terms`; of any quality."""
    out = np.zeros((len(STRANDS) + 2, len(BASES) + 2, len(quals), len(COUNTS)))
    for s, pair in enumerate(("CT", "GA")):
        out[s, :, :, 4 + s] = out[s, :-1, :, 6 + s] = 1.0
        for k, b in enumerate(pair):
            out[s, BASES.index(b), :, 2 * s + k] = 1.0
    return out


def genotype_likelihoods(bases: DataFrame, meth: Column | float = 0.5, conversion: float = CONVERSION, over: float = OVER_CONVERSION,
                         by_strand: bool = False, around: int = 0, counts: bool = False) -> DataFrame:
    """Ten log10 likelihoods per position: ten sums in one aggregation, from the reads if they are dealt by tile, else combined map-side.

    From reads dealt with a halo that holds them, the reference bases `around` a position come with it; with `counts`
    also the C, T and all reads of either strand.
    """
    dealt = dealt_reads(bases)
    if dealt and not isinstance(meth, Column):
        own = lambda quals: likelihood_terms(quals, meth, conversion, over)
        both = lambda quals: np.concatenate([own(quals), conversion_terms(quals)], axis=-1)
        return base_sums(dealt, both if counts else own, GENOTYPES + COUNTS * counts, by_strand, around if around <= dealt.halo else 0)
    keys = place(bases, "ref_base")
    rows = bases.select(*keys, "strand", *[c.alias(g) for g, c in likelihood_columns(meth, conversion, over).items()])
    sums = [F.sum(g).alias(g) for g in GENOTYPES]
    if by_strand:
        for s, name in (("+", "fw"), ("-", "rev")):
            sums += [F.coalesce(F.sum(F.when(F.col("strand") == s, F.col(g))), F.lit(0.0)).alias(f"{g}_{name}") for g in GENOTYPES]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("depth"), *sums)


def prior_value(ref: str, genotype: str, het: float, ti_tv: float, ref_error: float = REFERENCE_ERROR) -> float:
    """Reference-polarised prior of one genotype."""
    tv = 1.0 / (ti_tv + 1.0)
    ti = tv * ti_tv
    tri = het * ref_error
    a, b = genotype
    rate = lambda x: ti if x == PARTNER[ref] else tv
    if a == b == ref:
        return 1.0 - 1.5 * het
    if a == b:
        return het / 2.0 * rate(a)
    if ref in (a, b):
        return (het - tri) * rate(b if a == ref else a)
    return tri * (ti if PARTNER[ref] in (a, b) else tv)


def prior_columns(ref: Column, het: float = HETEROZYGOSITY, ti_tv: float = TI_TV, known: Column | None = None,
                  known_het: float = KNOWN_HETEROZYGOSITY) -> dict[str, Column]:
    """log10 priors by genotype; known variant positions use their own heterozygosity."""
    rates = [het] if known is None else [het, known_het]
    at = _letter(ref) if known is None else _letter(ref) + F.when(F.coalesce(known, F.lit(False)), len(BASES)).otherwise(0)
    return {g: _entry([prior_value(r, g, h, ti_tv) for h in rates for r in BASES], at) for g in GENOTYPES}


def _letter(ref: Column) -> Column:
    """Place of a base in ACGT; null for others."""
    at = F.when(ref == BASES[0], 0)
    for i, b in enumerate(BASES[1:], 1):
        at = at.when(ref == b, i)
    return at


def _entry(values: list[float], at: Column) -> Column:
    """Logarithm of one of the values: a lookup, not a chain of comparisons for each."""
    return F.get(F.array(*[F.log10(F.lit(v)) for v in values]), at)


def bisulfite_prior_columns(ref: Column, het: float = HETEROZYGOSITY, conversion: float = CONVERSION, ref_error: float = REFERENCE_ERROR) -> dict[str, Column]:
    """log10 priors that allow for conversion: at a reference C or T, C and T are hardly told apart.

    There the reference genotype and the heterozygotes with it share what is left of its prior without
    conversion, and the other of CC and TT gets what conversion makes of it.
    """
    same, mixed, other, tri = 1 - 1.5 * het, het, het / 2, het * ref_error

    def value(r: str, g: str) -> float:
        a, b = g
        if a == b == r:
            return same * (1 - conversion) if r in "CT" else same
        if a == b:
            return other / 3 + (same * conversion if {r, a} == {"C", "T"} else 0.0)
        if r in g:
            return same * (1 - conversion) if r in "CT" else (mixed - tri) / 3
        return tri / 3

    return {g: _entry([value(r, g) for r in BASES], _letter(ref)) for g in GENOTYPES}


def call_genotypes(likelihoods: DataFrame, het: float = HETEROZYGOSITY, ti_tv: float = TI_TV, known: Column | None = None, prior: dict[str, Column] | None = None) -> DataFrame:
    """Best and second genotype by posterior, their phred ratio and the normalised best posterior.

    `prior` replaces the reference-polarised priors.
    """
    prior = prior or prior_columns(F.col("ref_base"), het, ti_tv, known)
    d = likelihoods.withColumns({f"_p{g}": F.col(g) + prior[g] for g in GENOTYPES})

    def best(other_than: str | None, p: str, at: str) -> DataFrame:
        """Highest posterior and the first genotype that has it; without any, the first genotype."""
        left = lambda i: F.col(f"_p{GENOTYPES[i]}") if other_than is None else F.when(F.col(other_than) != i, F.col(f"_p{GENOTYPES[i]}"))
        high = d.withColumn(p, F.greatest(*[left(i) for i in range(len(GENOTYPES))]))
        first = F.when(left(0) == F.col(p), 0)
        for i in range(1, len(GENOTYPES)):
            first = first.when(left(i) == F.col(p), i)
        return high.withColumn(at, first.otherwise(0 if other_than is None else F.when(F.col(other_than) == 0, 1).otherwise(0)))

    d = best(None, "_best", "_b")
    d = best("_b", "_second", "_s")
    # as a generated row: conditions on the call are not moved below it, where each would work it out again
    name = lambda at: F.get(F.array(*[F.lit(g) for g in GENOTYPES]), F.col(at))
    call = F.struct(name("_b").alias("genotype"), name("_s").alias("runner_up"), (10.0 * (F.col("_best") - F.col("_second"))).alias("ratio"))
    d = d.select(*likelihoods.columns, *[f"_p{g}" for g in GENOTYPES], "_best", F.inline(F.array(call)))
    total = sum(F.pow(F.lit(10.0), F.col(f"_p{g}") - F.col("_best")) for g in GENOTYPES)
    out = d.withColumn("log10_posterior", -F.log10(total)).drop("_best", *[f"_p{g}" for g in GENOTYPES])
    out.by_tile = by_tile(likelihoods)
    return out


def call_with_known(likelihoods: DataFrame, sites: DataFrame, het: float = HETEROZYGOSITY, ti_tv: float = TI_TV) -> DataFrame:
    """Calls in which known variant sites (chrom, pos; repeats count once) have the prior of known variants; adds `known`.

    The site list is a table of any size: it is joined by position, and Spark broadcasts it only if its size allows.
    Both calls are made before that, so the ten likelihoods move only if they are asked for.
    """
    marks = sites.select("chrom", "pos").distinct().withColumn("_known", F.lit(True))
    names = ["genotype", "runner_up", "ratio", "log10_posterior"]
    usual = call_genotypes(likelihoods, het, ti_tv).withColumnsRenamed({n: f"_usual_{n}" for n in names})
    rows = call_genotypes(usual, KNOWN_HETEROZYGOSITY, ti_tv).join(marks, ["chrom", "pos"], "left")
    known = F.coalesce("_known", F.lit(False))
    return rows.select("chrom", "pos", *[c for c in likelihoods.columns if c not in ("chrom", "pos")], known.alias("known"),
                       *[F.when(known, F.col(n)).otherwise(F.col(f"_usual_{n}")).alias(n) for n in names])


def confident(calls: DataFrame, min_ratio: float = 30.0, variants_only: bool = False) -> DataFrame:
    out = calls.filter(F.col("ratio") >= min_ratio)
    return out.filter(F.col("genotype") != F.concat("ref_base", "ref_base")) if variants_only else out


def alternate_allele(genotype: Column, runner_up: Column, ref: Column) -> Column:
    """First allele of the best, else of the second genotype that is not the reference."""
    out = None
    for g in (genotype, runner_up):
        for i in (1, 2):
            a = F.substring(g, i, 1)
            out = F.when(a != ref, a) if out is None else out.when(a != ref, a)
    return out


def strand_bias(likelihoods: DataFrame, het: float = HETEROZYGOSITY, ti_tv: float = TI_TV, confident_ratio: float | None = None) -> DataFrame:
    """Strand score from forward-only and reverse-only posteriors of reference, mixed and variant genotype.

    Positions called homozygous reference at `confident_ratio` or more have no variant to score and are skipped.
    """
    d = call_genotypes(likelihoods, het, ti_tv)
    if confident_ratio is not None:
        d = d.filter(~((F.col("genotype") == F.concat("ref_base", "ref_base")) & (F.col("ratio") >= confident_ratio)))
    d = d.withColumn("alt", alternate_allele(F.col("genotype"), F.col("runner_up"), F.col("ref_base")))
    prior = prior_columns(F.col("ref_base"), het, ti_tv)
    pairs = {"ref": ("ref_base", "ref_base"), "mix": ("ref_base", "alt"), "alt": ("alt", "alt")}

    def post(kind: str, suffix: str) -> Column:
        x, y = (F.col(c) for c in pairs[kind])
        name = F.concat(F.least(x, y), F.greatest(x, y))
        out = None
        for g in GENOTYPES:
            v = F.col(g + suffix) + prior[g]
            out = F.when(name == g, v) if out is None else out.when(name == g, v)
        return out

    def log_sum(a: Column, b: Column) -> Column:
        hi = F.greatest(a, b)
        return hi + F.log10(F.pow(F.lit(10.0), a - hi) + F.pow(F.lit(10.0), b - hi))

    var = {s: log_sum(post("mix", s), post("alt", s)) for s in ("", "_fw", "_rev")}
    fwd = var["_fw"] + post("ref", "_rev") - var[""]
    rev = var["_rev"] + post("ref", "_fw") - var[""]
    return d.filter(F.col("alt").isNotNull()).withColumn("strand_bias", 10.0 * F.greatest(fwd, rev)).select(
        "chrom", "pos", "ref_base", "alt", "genotype", "strand_bias")


def cytosine_types(calls: DataFrame) -> DataFrame:
    """Type of called cytosines (CC on plus, GG on minus) from the genotypes around them.

    A neighbour counts with its base when it is called homozygous, otherwise it is unknown. Calls with the counts of
    `genotype_likelihoods` give types with the C, T and all reads of their own strand at the position.
    """
    hom = F.when(F.substring("genotype", 1, 1) == F.substring("genotype", 2, 1), F.substring("genotype", 1, 1)).otherwise("N")
    counted = [c for c in COUNTS if c in calls.columns]
    here = calls.select(*place(calls), hom.alias("b"), *counted)
    n = beside(here, "b", 2, counted) if by_tile(calls) and "home" in calls.columns else base_neighbours(here, 2, 2, base="b")
    plus = F.col("b") == "C"
    comp = lambda c: F.translate(F.col(c), "ACGT", "TGCA")
    first = F.when(plus, F.col("b_p1")).otherwise(comp("b_m1"))
    second = F.when(plus, F.col("b_p2")).otherwise(comp("b_m2"))
    side = lambda x: F.when(plus, F.col(f"{x}_plus")).otherwise(F.col(f"{x}_minus"))
    own = [*[F.when(side("known") > 0, side(x)).alias(f"{x}_reads") for x in "ct"], side("n").alias("reads")] if counted else []
    return n.filter(F.col("b").isin("C", "G")).select(
        "chrom", "pos", F.when(plus, "+").otherwise("-").alias("strand"), context_class(F.lit("C"), first, second).alias("type"), *own)


def variant_classes(calls: DataFrame) -> DataFrame:
    """Cytosines that a called variant changes, or whose context it changes.

    Class 1: one of the two alleles is the cytosine itself; 2 and 3: the variant is the first or the
    second base after it. One row per variant, class and strand with the cytosine's place and the
    three bases from it under either allele (N where no call is near). The alleles of a homozygous
    variant are the reference base and the called one. Neighbours are reference bases.
    """
    n = base_neighbours(calls, 2, 2)
    hom = F.substring("genotype", 1, 1) == F.substring("genotype", 2, 1)
    first, second = F.when(hom, F.col("ref_base")).otherwise(F.substring("genotype", 1, 1)), F.substring("genotype", 2, 1)
    n = n.filter(F.col("genotype") != F.concat("ref_base", "ref_base")).withColumns({"_a": first, "_b": second})

    def row(klass: int, strand: str) -> Column:
        sign, own = (1, "C") if strand == "+" else (-1, "G")

        def base(k: int, allele: str) -> Column:
            """Base k places after the variant along the strand."""
            at = k * sign
            c = F.col(allele) if k == 0 else F.coalesce(F.col(f"ref_base_{'p' if at > 0 else 'm'}{abs(at)}"), F.lit("N"))
            return c if strand == "+" else F.translate(c, "ACGT", "TGCA")

        back = klass - 1
        hit = (F.col("_a") == own) | (F.col("_b") == own) if back == 0 else F.col(f"ref_base_{'m' if sign > 0 else 'p'}{back}") == own
        context = lambda allele: F.concat(*[base(k - back, allele) for k in range(3)])
        return F.when(hit, F.struct(F.lit(klass).alias("class"), F.lit(strand).alias("strand"), (F.col("pos") - sign * back).alias("cytosine_pos"), context("_a").alias("context_a"), context("_b").alias("context_b")))

    rows = F.filter(F.array(*[row(k, s) for k in (1, 2, 3) for s in "+-"]), lambda x: x.isNotNull())
    return n.select("chrom", "pos", "ref_base", "genotype", "ratio", F.inline(rows))


def variant_methylation(bases: DataFrame, calls: DataFrame) -> DataFrame:
    """`variant_classes` with the C and T reads of each cytosine's own strand."""
    plus = F.col("strand") == "+"
    c, t = F.col("base") == F.when(plus, "C").otherwise("G"), F.col("base") == F.when(plus, "T").otherwise("A")
    if dealt := dealt_reads(bases):
        sums = base_sums(dealt, conversion_terms, COUNTS)
        sums = (sums.filter("home") if dealt.halo else sums).fillna(0.0, COUNTS)
        # positions come by tile and by reference base, which may be more than one
        rows = sums.select("chrom", F.col("pos").alias("cytosine_pos"), F.inline(F.array(*[
            F.struct(F.lit(s).alias("strand"), *[F.col(f"{x}_{name}").cast("bigint").alias(f"{x}_reads") for x in "ct"]) for s, name in (("+", "plus"), ("-", "minus"))])))
        reads = rows.filter(F.col("c_reads") + F.col("t_reads") > 0).groupBy("chrom", "cytosine_pos", "strand").agg(F.sum("c_reads").alias("c_reads"), F.sum("t_reads").alias("t_reads"))
    else:
        own = (bases.filter("home") if "home" in bases.columns else bases).filter(c | t)
        reads = own.groupBy(*place(own.drop("home")), "strand").agg(F.count(F.when(c, 1)).alias("c_reads"), F.count(F.when(t, 1)).alias("t_reads")).withColumnRenamed("pos", "cytosine_pos").drop("tile")
    out = variant_classes(calls).join(reads, ["chrom", "cytosine_pos", "strand"], "left")
    return out.withColumns({k: F.coalesce(k, F.lit(0)).cast("bigint") for k in ("c_reads", "t_reads")})


def called_methylation(bases: DataFrame, types: DataFrame) -> DataFrame:
    """C and T reads of the cytosine's own strand at called cytosines; types may have them already (`cytosine_types`)."""
    if "reads" in types.columns:
        found = types.filter(F.col("chrom").isNotNull() & (F.col("reads") > 0))
        return found.groupBy("chrom", "pos", "strand", "type").agg(F.sum("c_reads").alias("c_reads"), F.sum("t_reads").alias("t_reads"))
    j = bases.join(types, ["chrom", "pos", "strand"])
    c = F.when(F.col("strand") == "+", F.col("base") == "C").otherwise(F.col("base") == "G")
    t = F.when(F.col("strand") == "+", F.col("base") == "T").otherwise(F.col("base") == "A")
    return j.groupBy("chrom", "pos", "strand", "type").agg(F.sum(c.cast("bigint")).alias("c_reads"), F.sum(t.cast("bigint")).alias("t_reads"))


def methylation_by_type(counts: DataFrame) -> DataFrame:
    return counts.groupBy("type").agg((F.sum("c_reads") / F.nullif(F.sum("c_reads") + F.sum("t_reads"), F.lit(0))).alias("meth"))


def genotype(bases: DataFrame, methylation: float = 0.5, conversion: float = CONVERSION, over: float = OVER_CONVERSION,
             het: float = HETEROZYGOSITY, ti_tv: float = TI_TV, passes: int = 2) -> DataFrame:
    """Calls with a second pass that uses the methylation estimated per cytosine type in the first.

    The estimate is a table of one row per type; positions without a called type keep the default.
    """
    first = call_genotypes(genotype_likelihoods(bases, methylation, conversion, over), het, ti_tv)
    if passes < 2:
        return first
    types = cytosine_types(first)
    level = methylation_by_type(called_methylation(bases, types))
    typed = types.join(level, "type").select("chrom", "pos", "meth")
    second = bases.join(typed, ["chrom", "pos"], "left")
    return call_genotypes(genotype_likelihoods(second, F.coalesce("meth", F.lit(methylation)), conversion, over), het, ti_tv)


