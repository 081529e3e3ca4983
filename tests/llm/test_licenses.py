"""License scans: hand-made texts, and every block against every template in SQL."""

from duskwatch.llm import licenses
from tests.llm.oracle import connect, same


def test_given_documents_agree_with_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert same(licenses.scan_licenses(docs), connect(documents=docs), licenses.SQL) == 200


def test_made_up_texts_agree_with_brute_force(docs_of):
    filler = " ".join(f"x{i}" for i in range(45))
    texts = [
        None, "", "...", "CC-BY cc by cc by", "all Rights\nreserved", "overall rights reserved", "ALL RIGHTS RESERVEDé", "General  Public, License v3",
        f"{filler} Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation {filler}",
        "Permission is hereby granted free of charge to any person", "licensed under the apache license", "licence apache", f"{filler} {filler} released under the mit license",
        "cc by\u2028all rights all rights reserved", "line\u2028all rights reserved", "the the of and",
    ]
    docs = docs_of([*enumerate(texts), (None, "cc by"), (3, "mit license released under"), (3, "mit license released under")])
    out = licenses.scan_licenses(docs)
    same(out, connect(documents=docs), licenses.SQL)
    rows = {r["doc_id"]: r for r in out.where("doc_id <> 3").collect()}
    assert (rows[4]["n_base"], rows[4]["base_labels"], rows[4]["score"]) == (1, "reserved", 1.0)
    assert "mit-notice" in rows[8]["labels"] and rows[9]["labels"] == ""
    assert (rows[13]["n_base"], rows[13]["first_word"], rows[13]["last_word"]) == (1, 3, 3)


def test_empty_table(docs_of):
    assert licenses.scan_licenses(docs_of([])).count() == 0
