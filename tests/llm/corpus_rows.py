"""Rows with nulls, empty, very long and repeated texts, and columns whose names clash."""

EXTRA = ["taken", "size", "key", "value", "hash", "place", "start", "end", "ledger", "measured", "fail_bits", "component_id", "fingerprint",
         "text_hash", "mix_key", "copy", "plan_source", "plan_key", "drop_id", "cut_doc", "judged", "found", "host", "path", "label"]


def documents(spark, rows):
    """(doc_id, text, lang, source) rows as documents, with other columns whose names operators use themselves."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA)
    full = [(i, t, lang, s, None if t is None else len(t), *["x"] * len(EXTRA)) for i, t, lang, s in rows]
    return spark.createDataFrame(full, schema)


PROSE = ("The quick brown foxes of the northern hills went down to the river at noon. They found nobody there who could tell them the way. "
         "So they waited until evening came, and the ferryman returned with lamps and bread. Nobody spoke while the boat crossed the water. ")
LONG = " ".join(f"word{k % 977} of{k % 31} the{k % 7}." for k in range(40_000))
ODD_ROWS = [
    (None, None, None, None), (None, PROSE, None, "a"), (1, None, "en", "a"), (2, "", "en", "b"), (3, " \t\n\r\x0b\x0c ", "en", "b"),
    (4, PROSE, "en", "a"), (5, PROSE, "en", None), (5, PROSE, "en", None), (6, "one", None, "a"), (7, "one two", "de", "a"),
    (8, "É́ ünï \u00a0x \U0001f642 <|endoftext|> it's", "fr", "c"), (9, LONG, "en", "c"), (10, LONG, "en", "c"), (11, "x" * 300_000, "en", "a"),
]
