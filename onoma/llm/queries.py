"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from onoma.llm.bpe import op1_bpe
from onoma.llm.decontaminate import OP10_SQL, op10_decontamination
from onoma.llm.jaccard_join import OP6_SQL, op6_jaccard_join
from onoma.llm.kneser_ney import op5_kneser_ney
from onoma.llm.language_id import op9_language_id
from onoma.llm.line_runs import OP7_SQL, op7_line_dedup
from onoma.llm.ogg import op8_media
from onoma.llm.pii import op3_pii
from onoma.llm.quality_crf import op4_quality
from onoma.llm.sharding import op2_sharding

QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_sharding": op2_sharding,
    "op3_pii": op3_pii,
    "op4_quality": op4_quality,
    "op5_kneser_ney": op5_kneser_ney,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_line_dedup": op7_line_dedup,
    "op8_media": op8_media,
    "op9_language_id": op9_language_id,
    "op10_decontamination": op10_decontamination,
}
ORACLES = {"op6_jaccard_join": OP6_SQL, "op7_line_dedup": OP7_SQL, "op10_decontamination": OP10_SQL}
