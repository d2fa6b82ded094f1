from __future__ import annotations

LONG = " ".join(f"word{i % 977} the {i}" for i in range(20_000))
WEIRD = [
    (1, "Plain text here, with a few words in it.", "en", "a"),
    (2, None, None, None),
    (3, "", "en", "a"),
    (4, LONG, "en", None),
    (5, "Plain text here, with a few words in it.", "en", "b"),
    (5, "Plain text here, with a few words in it.", "en", "b"),
    (None, "No id here at all, only words.", "en", "c"),
    (7, "   \n\t ", "fr", "c"),
    (8, "é😀 ünïcode 1" * 40, "fr", "a"),
    (9, "1" * 5000, "fr", "a"),
]


def documents(spark, rows):
    """documents(doc_id, text, lang, source, n_chars) with columns whose names clash with those operators use."""
    full = [(*r, len(r[1]) if r[1] is not None else None, "x", 1, "y", 2.0, "z") for r in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, component_id string, size int, fp string, score double, row string")


def by_id(rows, key="doc_id"):
    out = {}
    for r in rows:
        out.setdefault(r[key], []).append(tuple(r))
    return out
