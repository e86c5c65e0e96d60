"""Queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from . import ann, decontam, filteraudit, htmlmain, linededup, neardup, packing, pfp, simhash, sstable, tokenalign, toxicity, warc

QUERIES = {
    f.__name__: f
    for f in (
        sstable.op1_sstable_shards,
        toxicity.op2_toxicity_chain,
        packing.op3_harmonic_packing,
        warc.op4_warc_segments,
        linededup.op5_winnowed_line_dedup,
        ann.op6_multiprobe_neighbours,
        pfp.op7_prefix_free_repeats,
        decontam.op8_suffix_array_decontamination,
        htmlmain.op9_recurrent_main_text,
        neardup.op10_tensored_near_duplicates,
        filteraudit.op11_adjacent_swap_audit,
        tokenalign.op12_overlap_components,
        simhash.op13_anchor_covered_simhash,
    )
}

ORACLES: dict[str, str] = {
    "op4_warc_segments": warc.ORACLE,
    "op5_winnowed_line_dedup": linededup.ORACLE,
    "op6_multiprobe_neighbours": ann.ORACLE,
    "op7_prefix_free_repeats": pfp.ORACLE,
    "op8_suffix_array_decontamination": decontam.ORACLE,
    "op10_tensored_near_duplicates": neardup.ORACLE,
    "op11_adjacent_swap_audit": filteraudit.ORACLE,
}
