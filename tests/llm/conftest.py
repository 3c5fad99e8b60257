import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """Nulls, empty texts, copies, a very long text, a null id, and an extra column."""
    base = "the quick brown fox jumps over the lazy dog and then runs home to sleep all night long in peace"
    other = " ".join(f"w{k}" for k in range(60))
    rows = [
        (1, base + ". " + other, "en"),
        (2, other + " tail", "en"),
        (3, None, "en"),
        (4, "", None),
        (5, base + ". " + other, "en"),
        (5, base + ". " + other, "en"),
        (6, "Ünï 'd don't 123 　 x" * 2000, "de"),
        (7, "  \n ", "de"),
        (None, "der und die das ist nicht " * 5, "de"),
        (8, "der und die das ist nicht ein " * 6 + "<|endoftext|> end", "de"),
        (9, "mail a.b@c.example.org, +1 (017) 555-5036; 4111 1111 1111 1111, 10.0.0.255, 10.0.0.256, DE89 3704 0044 0532 0130 00", None),
        (10, "Licensed under the Apache License, Version 2.0. MIT License; gnu general public license!", "en"),
    ]
    schema = "doc_id long, text string, lang string, d string, n_words string"
    return spark.createDataFrame([(*r, "extra", "clash") for r in rows], schema)
