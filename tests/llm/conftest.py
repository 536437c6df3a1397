import pytest

from donorlens.llm.common import find_package

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs_of(spark):
    find_package(spark)

    def build(rows, schema="doc_id long, text string, lang string, source string, n_chars long, h long, row string, label int"):
        width = len(schema.split(", "))
        return spark.createDataFrame([(*r, *[None] * (width - len(r))) for r in rows], schema)

    return build


#: Null, empty, blank, short, tied, repeated and very long texts; a null id, a repeated row.
ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (None, "no id here at all today"), (5, "Ünï çødé " * 30),
    (6, "word " * 60000), (7, "a" * 70000), (8, "x@y.zz, +1 (743) 555-3824, host 10.0.0.1, card 4111 1111 1111 1111"),
    (9, "one two three\nfour five six\nseven eight nine\nten"), (10, "one two three\nfour five six\nseven eight nine\nten"),
]
