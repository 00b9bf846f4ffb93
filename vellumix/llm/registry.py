"""Queries of this subpackage and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from . import balls, chat, fim, secrets, warc
from .balls import op11_ball_clusters
from .bpe import op2_byte_bpe
from .bpe_stream import op13_bpe_stream
from .chat import op5_chat_formatting
from .decontaminate import op8_benchmark_decontamination
from .fim import op12_fim
from .mpegts import op1_mpeg_ts
from .quality import op6_quality_classifier
from .secrets import op4_secret_scans
from .simhash import op9_simhash_near_dedup
from .suffix import op3_suffix_array_dedup
from .toxicity import op10_toxicity
from .warc import op7_warc

QUERIES = {
    "op1_mpeg_ts": op1_mpeg_ts,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_suffix_array_dedup": op3_suffix_array_dedup,
    "op4_secret_scans": op4_secret_scans,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_warc": op7_warc,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_ball_clusters": op11_ball_clusters,
    "op12_fim": op12_fim,
    "op13_bpe_stream": op13_bpe_stream,
}

ORACLE = {
    "op4_secret_scans": secrets.ORACLE_SQL,
    "op5_chat_formatting": chat.ORACLE_SQL,
    "op7_warc": warc.ORACLE_SQL,
    "op11_ball_clusters": balls.ORACLE_SQL,
    "op12_fim": fim.ORACLE_SQL,
}
