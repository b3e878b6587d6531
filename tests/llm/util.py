"""A small table of odd documents, and helpers."""

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def odd_docs(spark, extra=()):
    """Nulls, empty and long texts, ties and repeated rows, and extra columns with clashing names."""
    long = " ".join(WORDS[(i * i + i // 7) % 20] + str(i % 97) for i in range(3000))
    rows = [
        (1, "one two three", "x", 1),
        (2, "one  two\tthree", "x", 2),
        (3, "one two three", None, None),
        (3, "one two three", None, None),
        (4, None, "x", 4),
        (5, "", "x", 5),
        (6, long, "y", 6),
        (7, long, "y", 7),
        (8, long.replace("alpha0", "omega"), "y", 8),
        (9, "Å ß été \U0001f600 mail a.b@c.org +1 (743) 555-3824, 10.0.0.1", "y", 9),
        (10, " \n\t ", "z", 10),
        *extra,
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, digest string, n int")


def empty_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, digest string, n int")
