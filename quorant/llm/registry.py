"""Queries of the training-data operators, and the SQL that DuckDB can run for the same rows."""

from . import bitslices, bpe, chat, langid, packing, pieces, pii, prefixhash, quality, repair, secrets, sharding, simhash

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_packing": packing.op2_packing,
    "op3_simhash": simhash.op3_simhash,
    "op4_pii": pii.op4_pii,
    "op5_chat": chat.op5_chat,
    "op6_bpe": bpe.op6_bpe,
    "op7_fingerprints": prefixhash.op7_fingerprints,
    "op8_langid": langid.op8_langid,
    "op9_secrets": secrets.op9_secrets,
    "op10_sharding": sharding.op10_sharding,
    "op12_pieces": pieces.op12_pieces,
    "op13_repair": repair.op13_repair,
}

ORACLE_SQL = {"op1_quality": quality.ORACLE_SQL, "op5_chat": chat.ORACLE_SQL, "op9_secrets": secrets.ORACLE_SQL}

#: Those over the shop's tables.
SHOP_QUERIES = {"op11_ties": bitslices.op11_ties}

SHOP_SQL = {"op11_ties": bitslices.ORACLE_SQL}
