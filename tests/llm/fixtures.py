"""Edge-case texts that every operator has to bear."""

EDGE = [None, "", " ", "\n\n", "word", "É é ß 🙂 漢字", "x" * 5000, "a b " * 4000, "same text here", "same text here",
        "tab\tand\x0bvertical\x00null", " line", "1234567 89"]


def documents(spark, texts, extra=True):
    rows = [(i, t, "en" if i % 2 else None, f"src{i % 3}" if i % 5 else None, len(t) if t else None, "clash", 1)
            for i, t in enumerate(texts)]
    rows += [(None, "no id here", "en", "s", 10, "clash", 2), (3, "\n\n", "en", "s", 2, "clash", 3)] if extra else []
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, n int").repartition(3)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
