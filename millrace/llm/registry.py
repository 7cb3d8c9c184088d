"""The queries of the training-data operators and the SQL of those that SQL can express."""

from millrace.llm import chat, decontamination, embeddings, html_text, mixing, sharding, simhash, suffix_dedup, toxicity, warc

QUERIES = {
    "op1_suffix": suffix_dedup.op1_suffix,
    "op2_embeddings": embeddings.op2_embeddings,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_warc": warc.op4_warc,
    "op5_simhash": simhash.op5_simhash,
    "op6_decontamination": decontamination.op6_decontamination,
    "op7_chat": chat.op7_chat,
    "op8_mixing": mixing.op8_mixing,
    "op9_sharding": sharding.op9_sharding,
    "op10_html": html_text.op10_html,
}

SQL = {"op1_suffix": suffix_dedup.OP1_SQL, "op2_embeddings": embeddings.OP2_SQL, "op4_warc": warc.OP4_SQL, "op7_chat": chat.OP7_SQL, "op8_mixing": mixing.OP8_SQL}
