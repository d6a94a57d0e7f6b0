"""CpG pairs of the base view: 29 statistics, variant filter, trailing windows, early and later cycles."""

from __future__ import annotations

from lociframe.operators import pairstats as P
from lociframe.plans.aggregates import rounded
from lociframe.plans.registry import question

FLIP = {"A": "T", "C": "G", "G": "C", "T": "A", "N": "N"}
SHARES = [s for s in P.STATS if "meth" in s or "snp" in s]
COUNTS = [s for s in P.STATS if s not in SHARES]


def _n(kind: str, side: str, strand: str, base: str) -> str:
    return f"{kind}_{side}{'p' if strand == '+' else 'm'}{base}"


def _record(kind_all: str = "n") -> str:
    """The statistics over tallies n_… and u_…, written from the point of view of each C."""
    out = {}
    for side, own, other, flip in (("fw", "+", "-", False), ("rev", "-", "+", True)):
        b = lambda x: FLIP[x] if flip else x
        for kind, tail in (("n", ""), ("u", "_collapsed")):
            c, t = _n(kind, side, own, b("C")), _n(kind, side, own, b("T"))
            bad = " + ".join([_n(kind, side, s, b(x)) for s in (own, other) for x in "GA"] + [_n(kind, side, other, b("T"))])
            out[f"{side}_depth{tail}"] = _n(kind, side, own, "N")
            out[f"{side}_meth{tail}"] = f"{c} / CAST(nullif({c} + {t}, 0) AS DOUBLE)"
            out[f"{side}_snp{tail}"] = f"({bad}) / CAST(nullif({bad} + {c} + {_n(kind, side, other, b('C'))}, 0) AS DOUBLE)"
    fd, rd = "n_fwpN", "n_revmN"
    out["meth_overall"] = f"CASE WHEN {fd} + {rd} = 0 THEN 0.0 ELSE (coalesce({out['fw_meth']}, 0) * {fd} + coalesce({out['rev_meth']}, 0) * {rd}) / CAST({fd} + {rd} AS DOUBLE) END"
    for k, (side, strand, flip) in enumerate((("fw", "+", False), ("rev", "+", False), ("rev", "-", True), ("fw", "-", True)), 1):
        out |= {f"snv{k}_{x.lower()}": _n("n", side, strand, FLIP[x] if flip else x) for x in "ACTG"}
    return ", ".join(f"{out[s]} AS {s}" for s in P.STATS)


def _tallies() -> str:
    one = lambda test, n: f"CAST(SUM(CASE WHEN {test} THEN {n} ELSE 0 END) AS BIGINT)"
    out = []
    for side in P.SIDES:
        for strand in "+-":
            at = f"side = '{side}' AND strand = '{strand}'"
            for b in "ACGT":
                out += [f"{one(f'{at} AND base = {chr(39)}{b}{chr(39)}', 1)} AS {_n('n', side, strand, b)}", f"{one(f'{at} AND first AND base = {chr(39)}{b}{chr(39)}', 1)} AS {_n('u', side, strand, b)}"]
            out += [f"{one(at, 1)} AS {_n('n', side, strand, 'N')}", f"{one(f'{at} AND first', 1)} AS {_n('u', side, strand, 'N')}"]
    return ", ".join(out)


PAIRS = f"""x AS (SELECT chrom, CASE ref_base WHEN 'C' THEN pos ELSE pos - 1 END AS pos, CASE ref_base WHEN 'C' THEN 'fw' ELSE 'rev' END AS side, strand, base,
  row_number() OVER (PARTITION BY chrom, pos, ref_base, strand, cycle ORDER BY read_id) = 1 AS first FROM v_base WHERE ref_base IN ('C', 'G')),
y AS (SELECT chrom, pos, {_tallies()} FROM x GROUP BY chrom, pos HAVING COUNT(DISTINCT side) = 2),
p AS MATERIALIZED (SELECT chrom, pos, {_record()} FROM y)"""
SHOWN = ", ".join(f"ROUND({s}, 6) AS {s}" if s in SHARES else s for s in P.STATS)


def _pairs(v):
    return P.pair_statistics(P.pair_state(v.base))


@question("j_cpg_pair_stats", "v_base", f"WITH {PAIRS} SELECT chrom, pos, {SHOWN} FROM p")
def cpg_pair_stats(v):
    return rounded(_pairs(v), *SHARES)


@question("f_pairs_without_variants", "v_base", f"WITH {PAIRS} SELECT chrom, pos, {SHOWN} FROM p WHERE NOT (coalesce(fw_snp, 0) >= 0.1 OR coalesce(rev_snp, 0) > 0.1)")
def pairs_without_variants(v):
    return rounded(P.without_variants(_pairs(v)), *SHARES)


WINDOW = 300


@question("w_pair_windows", "v_base", f"""WITH {PAIRS}
SELECT chrom, pos, COUNT(*) OVER b AS n_before, {", ".join(f"ROUND(avg({s}) OVER w, 6) AS mean_{s}" for s in P.STATS)} FROM p
WINDOW b AS (PARTITION BY chrom ORDER BY pos RANGE BETWEEN {WINDOW - 1} PRECEDING AND 1 PRECEDING), w AS (PARTITION BY chrom ORDER BY pos RANGE BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW)""")
def pair_windows(v):
    out = P.trailing_windows(_pairs(v), WINDOW, P.STATS)
    means = [f"mean_{s}" for s in P.STATS]
    return rounded(out.select("chrom", "pos", "n_before", *means), *means)


@question("a_cycle_shift", "v_base", """WITH s AS (
  SELECT chrom, pos, COUNT(*) FILTER (WHERE cycle BETWEEN 1 AND 20 AND base = 'C') AS lc, COUNT(*) FILTER (WHERE cycle BETWEEN 1 AND 20 AND base = 'T') AS lt,
    COUNT(*) FILTER (WHERE cycle BETWEEN 21 AND 40 AND base = 'C') AS mc, COUNT(*) FILTER (WHERE cycle BETWEEN 21 AND 40 AND base = 'T') AS mt FROM v_base WHERE strand = '+' AND ref_base = 'C' GROUP BY 1, 2),
r AS (SELECT chrom, pos, SUM(lt) OVER w / CAST(nullif(SUM(lt + lc) OVER w, 0) AS DOUBLE) AS low, SUM(mt) OVER w / CAST(nullif(SUM(mt + mc) OVER w, 0) AS DOUBLE) AS medium FROM s
  WINDOW w AS (PARTITION BY chrom ORDER BY pos RANGE BETWEEN 99 PRECEDING AND CURRENT ROW))
SELECT chrom, pos, ROUND(low, 6) AS low_share, ROUND(medium, 6) AS medium_share, ROUND(medium - low, 6) AS shift FROM r WHERE medium - low <> 0 AND abs(medium - low) < 1""")
def cycle_shift(v):
    return rounded(P.cycle_shift(v.base, 100, (1, 20), (21, 40)), "low_share", "medium_share", "shift")
