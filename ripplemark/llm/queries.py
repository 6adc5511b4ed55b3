"""The registered queries of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable


def queries() -> dict[str, Callable]:
    from .byte_dedup import op9_suffix_array_bytes
    from .decontamination import op2_winnow_decontaminate
    from .html_text import op6_wrapper_html
    from .licenses import op10_diagonal_licenses
    from .merkle import op11_interval_merkle
    from .mixing import op8_pivotal_mix
    from .prefix_trie import op12_ternary_trie
    from .quality import op1_rule_quality
    from .simhash import op7_pivot_simhash
    from .spotsigs import op5_spot_signatures
    from .substring import op4_automaton_substrings
    from .superminhash import op13_super_minhash
    from .toxicity import op3_lexicon_toxicity

    return {
        "op1_rule_quality": op1_rule_quality,
        "op2_winnow_decontaminate": op2_winnow_decontaminate,
        "op3_lexicon_toxicity": op3_lexicon_toxicity,
        "op4_automaton_substrings": op4_automaton_substrings,
        "op5_spot_signatures": op5_spot_signatures,
        "op6_wrapper_html": op6_wrapper_html,
        "op7_pivot_simhash": op7_pivot_simhash,
        "op8_pivotal_mix": op8_pivotal_mix,
        "op9_suffix_array_bytes": op9_suffix_array_bytes,
        "op10_diagonal_licenses": op10_diagonal_licenses,
        "op11_interval_merkle": op11_interval_merkle,
        "op12_ternary_trie": op12_ternary_trie,
        "op13_super_minhash": op13_super_minhash,
    }


def oracle_sql() -> dict[str, str]:
    """The others are learned, random, or rest on hashes and trees that SQL lacks; tests hold them against brute force or held-out labels."""
    from .oracles import OP2, OP4, OP9, OP10, OP11, OP12, OP13

    return {"op2_winnow_decontaminate": OP2, "op4_automaton_substrings": OP4, "op9_suffix_array_bytes": OP9, "op10_diagonal_licenses": OP10, "op11_interval_merkle": OP11, "op12_ternary_trie": OP12, "op13_super_minhash": OP13}
