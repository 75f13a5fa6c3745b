"""Columns of the fifteen tables, as DDL that ``spark.read.schema`` takes."""

from __future__ import annotations

# The tables and columns that studies share, and their types.
_DDL = {
    "align": "align_id long, align_length int, align_comparables int, align_identities int, align_differences int, align_gaps int, align_ns int, align_error int, align_pi double, align_indels int, align_gc double, align_average_gc double, align_comparable_runlist string, align_indel_runlist string, align_coding double, align_repeats double, align_coding_runlist string, align_repeats_runlist string",
    "chromosome": "chr_id long, common_name string, taxon_id int, chr_name string, chr_length int, assembly string",
    "sequence": "seq_id long, align_id long, chr_id long, seq_role string, seq_position int, common_name string, chr_name string, chr_start int, chr_end int, chr_strand string, seq_length int, seq_gc double, seq_runlist string, seq_seq string",
    "indel": "indel_id long, prev_indel_id long, align_id long, indel_start int, indel_end int, indel_length int, indel_seq string, indel_all_seqs string, indel_outgroup_seq string, left_extand int, right_extand int, indel_gc double, indel_freq int, indel_occured string, indel_type string, indel_slippage double, indel_coding double, indel_repeats double",
    "snp": "snp_id long, isw_id long, align_id long, snp_pos int, snp_target_base string, snp_query_base string, snp_all_bases string, snp_outgroup_base string, snp_mutant_to string, snp_freq int, snp_occured string, snp_coding double, snp_repeats double, snp_cpg double",
    "isw": "isw_id long, indel_id long, prev_indel_id long, align_id long, isw_indel_id long, isw_start int, isw_end int, isw_length int, isw_type string, isw_distance int, isw_density int, isw_differences int, isw_pi double, isw_gc double, isw_cv double, " + ", ".join(f"isw_d_{g}{f} double" for f in ("", "2", "3") for g in ("indel", "noindel", "bii", "bnn", "complex")) + ", isw_coding double, isw_repeats double, isw_cpg_pi double",
    "window": "window_id long, align_id long, window_start int, window_end int, window_length int, window_runlist string, window_comparables int, window_identities int, window_differences int, window_indel int, window_pi double, window_gc double, window_coding double, window_repeats double",
    "segment": "segment_id long, window_id long, segment_type string, segment_gc_mean double, segment_gc_std double, segment_gc_cv double, segment_gc_mdcw double",
    "extreme": "extreme_id long, prev_extreme_id long, window_id long, extreme_type string, extreme_left_amplitude double, extreme_right_amplitude double, extreme_left_wave_length double, extreme_right_wave_length double",
    "gsw": "gsw_id long, extreme_id long, prev_extreme_id long, window_id long, gsw_type string, gsw_distance int, gsw_distance_crest int, gsw_wave_length int, gsw_amplitude double, gsw_trough_gc double, gsw_crest_gc double, gsw_gradient int, gsw_cv double",
    "ofg": "ofg_id long, window_id long, ofg_tag string, ofg_type string",
    "ofgsw": "ofgsw_id long, ofg_id long, window_id long, ofgsw_type string, ofgsw_distance int, ofgsw_cv double",
    "gene": "gene_id long, window_id long, gene_stable_id string, gene_external_name string, gene_biotype string, gene_strand string, gene_is_full double, gene_is_known double, gene_multitrans int, gene_multiexons int, gene_tc_runlist string, gene_tl_runlist string, gene_description string",
    "exon": "exon_id long, prev_exon_id long, window_id long, gene_id long, exon_stable_id string, exon_strand string, exon_phase int, exon_end_phase int, exon_frame int, exon_rank int, exon_is_full double, exon_tl_runlist string, exon_seq string, exon_peptide string",
    "meta": "meta_id long, meta_key string, meta_value string",
}
TABLES: dict[str, str] = _DDL
