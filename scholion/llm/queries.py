"""The queries of this subpackage, by name, and their SQL where it can express them."""

from scholion.llm.decontamination import op2_benchmark_decontamination
from scholion.llm.lexical_search import ORACLE_SQL as OP11_SQL
from scholion.llm.lexical_search import op11_lexical_search
from scholion.llm.license_scan import op7_license_scan
from scholion.llm.lm_scoring import op8_lm_scoring
from scholion.llm.near_dedup import op5_minhash_near_dedup
from scholion.llm.ngram_join import ORACLE_SQL as OP12_SQL
from scholion.llm.ngram_join import op12_ngram_join
from scholion.llm.packing import op3_best_fit_packing
from scholion.llm.prefix_trie import ORACLE_SQL as OP13_SQL
from scholion.llm.prefix_trie import op13_prefix_trie
from scholion.llm.quality_classifier import op1_quality_classifier
from scholion.llm.quality_rules import ORACLE_SQL as OP6_SQL
from scholion.llm.quality_rules import op6_quality_rules
from scholion.llm.sharding import ORACLE_SQL as OP4_SQL
from scholion.llm.sharding import op4_sharding
from scholion.llm.suffix_dedup import op9_suffix_array_dedup
from scholion.llm.url_filter import op10_url_filter

QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_classifier,
        op2_benchmark_decontamination,
        op3_best_fit_packing,
        op4_sharding,
        op5_minhash_near_dedup,
        op6_quality_rules,
        op7_license_scan,
        op8_lm_scoring,
        op9_suffix_array_dedup,
        op10_url_filter,
        op11_lexical_search,
        op12_ngram_join,
        op13_prefix_trie,
    )
}
ORACLES: dict[str, str] = {"op4_sharding": OP4_SQL, "op6_quality_rules": OP6_SQL, "op11_lexical_search": OP11_SQL, "op12_ngram_join": OP12_SQL, "op13_prefix_trie": OP13_SQL}
