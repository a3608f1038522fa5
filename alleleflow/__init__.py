"""Gene-flow detection and orientation on Spark: allele counts, rarefaction statistics, classical
statistics and replicate-grouped evaluation, each an operator from DataFrames to a DataFrame."""

from alleleflow.operators.classical import (
    abba_baba, block_sums, d_by_trio, f3_statistic, f4_statistic, patterson_d,
    unweighted_jackknife, weighted_jackknife)
from alleleflow.operators.counts import (
    allele_cells, allele_counts, allele_table, joint_sfs, min_copies, polarise_ancestral,
    polarise_outgroup, site_frequencies)
from alleleflow.operators.inject import inject_migrants, injected_counts, pick_migrants
from alleleflow.operators.metrics import (
    brier_score, calibration_error, confusion_matrix, macro_f1, relative_error, roc_auc, spearman)
from alleleflow.operators.protocol import (
    banded_accuracy, group_folds, rate_bands, replicate_call, replicate_probabilities, with_folds)
from alleleflow.operators.rarefaction import (
    depth_sums, feature_matrix, finalise, leave_one_out, pair_private_ratio, per_locus)
from alleleflow.plans.analyses import (
    build_matrix, depth_requirement, detect_then_orient, direction_table, gate_report,
    subset_ablation, train_frozen, trio_report)
from alleleflow.plans.contract import (
    BLOCKS, CHANNELS, CLASSES, FEATURES, MOMENTS, MOMENT_SETS, validate_populations)
from alleleflow.sources.text import (
    read_geno, read_popmap, read_vcf, scan_region, scan_windows, write_popmap, write_records,
    write_variants, write_vcf)

__all__ = [n for n in dir() if not n.startswith("_")]
