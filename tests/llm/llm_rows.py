"""Rows that the tests of the operators share."""

LONG = " ".join(f"wort{i % 977}x{i % 13}" for i in range(30_000))
FULL = "doc_id long, text string, lang string, source string, n_chars int"
#: Names that operators use for their own columns.
CLASHING = ["n_words", "score", "kept", "component_id", "mark", "term", "positions", "slot", "shard", "ids", "n", "fp", "key", "held_out"]


def odd_rows(prose: list[str]) -> list[tuple]:
    """Nulls, empty and very long texts, repeated rows, texts that differ under one id."""
    rows = [(i, t, "en", "src0", len(t)) for i, t in enumerate(prose)]
    rows += [
        (100, None, None, None, None),
        (101, "", "en", None, 0),
        (102, " \n\t ", "de", "src1", 4),
        (103, LONG, "en", "src0", len(LONG)),
        (104, "x" * 6_000, None, "src0", 6_000),
        (105, prose[0], "en", "src0", 1),
        (105, prose[0], "en", "src0", 1),
        (106, prose[1], "en", "src0", 1),
        (106, "another text under the same id", "fr", "src0", 1),
        (None, prose[2], "en", "src0", 1),
        (None, None, None, None, None),
        (107, "null\0byte <|endoftext|> é漢😀 ΣΑΣ", "", "", 1),
    ]
    return rows


def prose_texts(n: int = 12) -> list[str]:
    words = ["alpha", "beta", "gamma", "delta", "house", "river", "stone", "cloud", "window", "paper", "seven", "green"]
    return [" ".join(words[(i * 7 + k * (i + 3) + k * k) % len(words)] + str((k * i) % 5) for k in range(70)) + "." for i in range(n)]


def ordered(rows) -> list[tuple]:
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))
