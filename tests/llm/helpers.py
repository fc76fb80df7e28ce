"""Tables with the awkward cases that every operator has to take."""

LONG = " ".join(f"w{i % 977}x{i}" for i in range(40_000))


def awkward(spark, extra=()):
    """Nulls in every column, empty and very long texts, ties and repeated rows, and extra columns."""
    rows = [
        (None, "a row without a key"), (1, None), (2, ""), (3, "   \n\n \t"), (4, LONG), (5, LONG), (6, "same text here for two rows"),
        (6, "same text here for two rows"), (7, "same text here for two rows"), (8, "x"), (9, None), (10, "ünïcode Σ ß 漢字  end"),
    ]
    names = ["doc_id", "text", *extra]
    data = [(*r, *["clash"] * len(extra)) for r in rows]
    return spark.createDataFrame(data, "doc_id long, text string" + "".join(f", {n} string" for n in extra)).select(*names)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")
