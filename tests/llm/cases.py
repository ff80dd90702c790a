"""Documents that every operator has to take: nulls, empty and long texts, repeats, ties, clashing columns, none."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, taken_id long, gone_id string, lang_found string, fp long, component_id string"


def texts(n=60, seed=5):
    rng = random.Random(seed)
    words = {"en": "the of and to that which are with from have this one word other time house people water".split(), "de": "der die und das nicht ist ein auch für über schön straße wasser haus zeit menschen wörter".split(), "fr": "le la les une est que qui dans pour très été où maison eau temps gens mots français".split()}
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(words))
        text = " ".join(rng.choice(words[lang]) + rng.choice(["", "", "", ",", ".\n"]) for _ in range(rng.randint(1, 160)))
        rows.append((i, text, lang))
    passage = " ".join(rng.choice(words["en"]) + str(i) for i in range(60))
    rows += [(n, f"one two {passage} three", "en"), (n + 1, f"{passage} other end here", "en"), (n + 2, rows[0][1], rows[0][2]), (n + 3, rows[1][1] + " more", rows[1][2])]
    rows += [(n + 4, None, None), (n + 5, "", "en"), (n + 6, " \n\t ", "de"), (None, "no id at all", "en"), (n + 7, "word " * 20_000, "en"), (n + 8, None, "fr"), (n + 9, "12 34 !!", None), (n + 10, "x" * 50_000, None)]
    return [*rows, rows[3], rows[3]]


def frame(spark, rows=None):
    """The documents with columns whose names clash with helper columns of the operators."""
    made = [(i, t, lang, f"src{(i or 0) % 7}", None if t is None else len(t), 1, "g", "l", 5, "c") for i, t, lang in (texts() if rows is None else rows)]
    return spark.createDataFrame(made, SCHEMA)
