import re

from lodestar.llm.licenses import BASE_PHRASES, NOTICES, license_spans, license_summary
from tests.llm.cases import odd_rows, prose, table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
MIT, APACHE = NOTICES[0][1], NOTICES[1][1]

TEXTS = [
    "Released under the MIT License. MIT-license, mit_license",
    "GNU General Public\nLicense and the gnu general public licenses; GNU general public license",
    "CC BY-NC 4.0, cc by cc by",
    "écc by apache\tlicense2 Apache License 2",
    prose(40, 1) + " " + MIT + " " + prose(40, 2),
    prose(10, 3) + " " + APACHE.replace("not use this file except", "not ever use this file save").replace("You may obtain", "One may obtain"),
    prose(20, 4) + " permission is hereby granted to nobody",
]


def brute(text):
    words = WORD.findall((text or "").translate(LOWER))
    places, labels = [], set()
    for phrase, label in BASE_PHRASES:
        listed = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(listed)] == listed:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_places_are_those_of_the_contract(spark):
    rows = odd_rows() + list(enumerate(TEXTS, 100))
    got = license_summary(table(spark, rows)).collect()
    want = {(i, *brute(t)) for i, t in rows}
    assert {(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got} == want
    assert len(got) == len({(i, t or "") for i, t in rows})
    assert all(0 <= r.score <= 1 and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) for r in got)


def test_notices_are_found_whole_and_changed(spark):
    labels = {r.doc_id: r.labels for r in license_summary(table(spark, list(enumerate(TEXTS)))).collect()}
    assert labels[4] == "mit" and labels[5] == "apache" and labels[6] == "" and labels[2] == "cc-by,cc-by-nc"
    span = license_spans(table(spark, [(1, TEXTS[4])])).where("kind = 'notice'").first()
    assert (span.first_word, span.end_word, span.cover) == (40, 40 + len(WORD.findall(MIT)), 1.0)


def test_empty_table(spark):
    assert license_summary(table(spark, [])).count() == 0
