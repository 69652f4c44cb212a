"""Labels of op9_licenses where template words are frequent or licences meet in one text."""

import pytest

from tessera.llm import licenses

BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
APACHE = "Licensed under the Apache License, Version 2.0"
DOCS = "doc_id long, text string"


@pytest.mark.parametrize("n", [3, 60])
def test_frequent_header(spark, n):
    """A header in a third of the documents, each time with other text, and a table of three documents."""
    rows = [(k, f"file {k} {BSD if k % 3 == 0 else 'plain text'} end {k}") for k in range(n)]
    got = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {k: ["bsd"] if k % 3 == 0 else [] for k in range(n)}


def test_many_licenses_in_one_text(spark):
    apache = [(k, f"{APACHE} module {k}") for k in range(1, 20)]
    every = " x ".join(text for _, text, _ in licenses.TEMPLATES)
    filler = [(k, f"prose {k}") for k in range(300, 800)]
    rows = [(0, f"{BSD}. {APACHE}."), *apache, (100, every), (100, every), (101, BSD + " x " + BSD[:60]), (102, "redistribution and use in source and binary forms"), (102, "redistribution and use in source and binary forms"), *filler]
    got = licenses.scan(spark.createDataFrame(rows, DOCS)).collect()
    labels = {r.doc_id: r.labels for r in got}
    assert labels[0] == ["apache", "apache-2.0", "bsd"] and labels[101] == ["bsd"] and len(got) == len(rows)
    assert set(labels[100]) == {name for name, _, _ in licenses.TEMPLATES} | {"apache", "cc-by", "gpl"}
    shares = [r.score for r in got if r.doc_id == 102]
    assert shares[0] == shares[1] <= 1
