"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ball_clusters import op11_ball_clusters
from .credential_scan import op4_secret_links
from . import oracles
from .decontamination import op1_simhash_decontamination
from .lexical_search import op12_lexical_max_tree
from .line_dedup import op13_line_dedup
from .near_duplicates import op9_weighted_minhash
from .pieces import op8_piece_scan
from .quality_classifier import op5_quality_fm
from .quality_rules import op3_quality_divergence
from .shards import op10_shard_interleave
from .token_counts import op6_token_rollup
from .url_filter import op2_url_markov
from .warc import op7_warc_derivatives


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash_decontamination": op1_simhash_decontamination,
        "op2_url_markov": op2_url_markov,
        "op3_quality_divergence": op3_quality_divergence,
        "op4_secret_links": op4_secret_links,
        "op5_quality_fm": op5_quality_fm,
        "op6_token_rollup": op6_token_rollup,
        "op7_warc_derivatives": op7_warc_derivatives,
        "op8_piece_scan": op8_piece_scan,
        "op9_weighted_minhash": op9_weighted_minhash,
        "op10_shard_interleave": op10_shard_interleave,
        "op11_ball_clusters": op11_ball_clusters,
        "op12_lexical_max_tree": op12_lexical_max_tree,
        "op13_line_dedup": op13_line_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_url_markov": oracles.urls(), "op3_quality_divergence": oracles.quality(), "op10_shard_interleave": oracles.shards(),
        "op11_ball_clusters": oracles.clusters(), "op12_lexical_max_tree": oracles.search(), "op13_line_dedup": oracles.lines(),
    }
