"""The registered queries of this package and, where SQL can state them, their DuckDB SQL."""

from dunlin.llm.language_id import op1_language_id
from dunlin.llm.conversation_repair import OP11_SQL, op11_conversation_repair
from dunlin.llm.cross_entropy import op9_cross_entropy
from dunlin.llm.fill_middle import OP12_SQL, op12_fill_middle
from dunlin.llm.jaccard_join import OP2_SQL, op2_jaccard_join
from dunlin.llm.license_spans import op13_license_spans
from dunlin.llm.neighbours import OP3_SQL, op3_neighbours
from dunlin.llm.passages import op4_passages
from dunlin.llm.phrase_index import OP7_SQL, op7_decontamination
from dunlin.llm.pieces_nbest import op8_sentencepiece
from dunlin.llm.run_index import OP10_SQL, op10_run_index
from dunlin.llm.token_file import op5_token_file
from dunlin.llm.toxicity import op6_toxicity

QUERIES = {f.__name__: f for f in (op1_language_id, op2_jaccard_join, op3_neighbours, op4_passages, op5_token_file, op6_toxicity, op7_decontamination, op8_sentencepiece, op9_cross_entropy, op10_run_index,
                                      op11_conversation_repair, op12_fill_middle, op13_license_spans)}
ORACLES: dict[str, str] = {"op2_jaccard_join": OP2_SQL, "op3_neighbours": OP3_SQL, "op7_decontamination": OP7_SQL, "op10_run_index": OP10_SQL, "op11_conversation_repair": OP11_SQL, "op12_fill_middle": OP12_SQL}
