import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, pii string, _size int, leaks int, kept string, n_words string, block int, shard string"


@pytest.fixture(scope="session")
def write(spark, tmp_path_factory):
    """Writes tables of a fixture and returns their folder. Documents get clashing extra columns; a row is (doc_id, text) or (doc_id, text, lang)."""

    def put(**tables):
        d = tmp_path_factory.mktemp("sf")
        for name, rows in tables.items():
            if name == "documents":
                full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None, "x", 1, 2, "y", "z", 3, "w") for r in rows]
                spark.createDataFrame(full, DOCS).repartition(3).write.parquet(f"{d}/documents.parquet")
            else:
                schema = {"pages": "page_id long, url string, html string, host string, text int", "benchmark": "item_id long, text string"}[name]
                spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
        return str(d)

    return put


#: Texts that every operator on documents must take: null, empty, blank, very long, repeated, with characters of all widths.
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "a " * 30_000), (5, "x" * 60_000), (6, "same text as another one here"), (7, "same text as another one here"), (None, "no id at all"), (8, "Überraschung 😀 中文\u00a0e\u0301 \x00 end"), (9, "9" * 50_000)]
