"""Questions against their oracle; LOCIFRAME_ALL=1 runs every key, otherwise a cross-section."""

import os

import compare
import pytest

from lociframe import plans

SOME = """s_scan_cytosine s_pileup_explode s_bed_line f_mutation f_context_class p_cytosine_class p_sample_order j_multisample
j_within_feature j_feature_overlap j_nearest_feature j_allpairs j_pairs_other_read a_meth_by_feature a_feature_shores a_cpg_venn
a_autocorr_pearson a_asm_fisher a_reads_to_cytosines a_nmer_enrichment w_scan_fixed w_scan_variable w_domains w_clusters_scored
w_feat_align_avg w_ndr u_subtract g_calls g_cytosine_types t_tumbling_counts t_session_domains
s_wig_read s_fasta_cpg a_feature_overlap_quads a_feature_distances j_cpg_pair_stats w_pair_windows a_type_states s_gpc_scan g_known_priors
a_variant_classes t_late_rows t_window_events w_clusters_capped w_read_tiers w_ndr_rank_test w_ndr_ks_test g_strand_bias s_vcf_lines
w_delta_align w_feat_align_matrix j_allele_specific f_nmer""".split()
KEYS = list(plans.load()) if os.environ.get("LOCIFRAME_ALL") else SOME
SF_DIR = f"{compare.TESTDATA}/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return compare.open_duck(SF_DIR)


@pytest.mark.parametrize("key", KEYS)
def test_question(spark, duck, key):
    ok, note = compare.check(spark, duck, SF_DIR, key, plans.load()[key])
    assert ok, note


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
