"""Recall and precision of the added spans on a corpus with planted spelled-out data, through the query."""

import random

from donorlens.llm import queries

NAMES = "anna bert carla dieter emma frank greta hugo ines jonas".split()
HOSTS = "mailhub webpost netzwerk correo boite".split()
PLAIN = ["We met at home at noon and talked about the weather.", "The shop at the corner sells 12 kinds of bread.", "Version 1.2.3 of the tool came out in 2019.",
         "Call it a day, she said, and dot the i.", "He ran 800 metres in 1 55 00 at the meeting.", "Look at the point (at the end) of the list."]


def planted(rng):
    rows, want = [], set()
    for doc_id in range(900):
        parts = rng.sample(PLAIN, 3)
        kind = doc_id % 3
        if kind == 1:
            span = f"{rng.choice(NAMES)}.{rng.choice(NAMES)}{rng.randint(1, 99)} (at) {rng.choice(HOSTS)} (dot) {rng.choice(['org', 'com', 'net'])}"
            parts.insert(1, f"E-mail: {span} please.")
        elif kind == 2:
            span = f"00{rng.randint(31, 49)} {rng.randint(10, 99)} {rng.randint(1000, 9999)} {rng.randint(10, 99)}"  # 12 digits: never a card
            parts.insert(2, f"Phone: {span} today.")
        text = " ".join(parts)
        rows.append((doc_id, text))
        if kind:
            at = text.index(span)
            want.add((doc_id, "email" if kind == 1 else "phone", at, at + len(span)))
    return rows, want


def test_planted_spans_are_added_and_plain_text_is_left_alone(spark, tmp_path):
    rows, want = planted(random.Random(12))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got, added = set(), 0
    for r in queries.op1_pii_weak_supervision(spark, str(tmp_path)).collect():
        added += r.n_added
        for span in filter(None, r.spans.split(",")):
            kind, a, b = span.split(":")
            got.add((r.doc_id, kind, int(a), int(b)))
    assert added == len(got)  # no planted span is a base span
    found = want & got
    assert len(found) / len(want) >= 0.8 and len(found) / len(got) >= 0.95, (len(want), len(got), len(found), sorted(got - want)[:5])
    assert not {doc_id for doc_id, *_ in got if doc_id % 3 == 0}
