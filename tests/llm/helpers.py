"""Documents with the odd cases every operator must stand."""

WORDS = "anther therion blean ontion thanin eresh onwhat thea ingst handor".split()


def text(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, score double, n_words int, _d long, _t string, _h int, kept_text string, row int, k int, words string, node long, fp long, root long, th long, key string, ids string"


def odd_rows() -> list[tuple]:
    shared, near = text(900, 60), text(901, 80)
    texts = [
        None, "", " \t\n ", "a", "ü é ß", text(1, 5), text(2, 400), text(2, 400), shared, text(3, 40) + "\n" + shared,
        near, near.replace("blean", "bleat", 1), text(4, 30) + " " + shared + " " + text(5, 30), "der " * 300, text(6, 6000),
        "Ünïcode " * 40, "x" * 500, "Zeile eins\nZeile eins\nZeile zwei", "A B C " * 20, text(7, 70),
    ]
    more = (7, "t", None, "kept", 1, 2, "w", 3, 4, 5, 6, "key", "ids")
    rows = [(i, t, ["en", "de", None][i % 3], "s", len(t or ""), 1, 0.5, 3, *more) for i, t in enumerate(texts)]
    return rows + [rows[6], (None, shared, *[None] * 19)]


def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def none(spark):
    return spark.createDataFrame([], SCHEMA)
