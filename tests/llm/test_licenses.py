"""op9 against a search of every template in every text."""

from pyspark.sql import functions as F

from docflow.llm import licenses, queries


def grams(words, k=5):
    k = min(k, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def brute(text):
    """Share of each template's shingles anywhere in the text."""
    own = grams(licenses.words_of(text or ""))
    out = {}
    for name, t in licenses.TEMPLATES.items():
        template = grams(licenses.words_of(t))
        out[name] = len(own & template) / len(template)
    return out


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {(r.doc_id, r.license) for r in queries.op9_license_scan(spark, sf).collect()}
    want = {(i, name) for i, t in texts.items() for name, share in brute(t).items() if share >= 0.8}
    assert got == want and got


def test_odd_texts(spark):
    notice = licenses.TEMPLATES["MIT-notice"]
    words = notice.split()
    filler = "lorem ipsum dolor sit amet " * 400
    odd = [None, "", "MIT License", filler + notice + " " + filler, notice, " ".join(words[: len(words) // 2]), filler + " ".join(words[8:]), notice.replace("charge", "cost"), (filler + notice) * 3]
    docs = spark.createDataFrame(list(enumerate(odd)) + [(4, notice)], "doc_id long, text string").withColumn("license", F.lit("clash"))
    rows = licenses.scan_documents(docs).collect()
    assert sorted(r.doc_id for r in rows if r.license == "MIT-notice") == [3, 4, 4, 6, 7, 8]
    whole = next(r for r in rows if r.doc_id == 3)
    assert whole.containment == 1 and whole.word_start == 2000 and whole.word_end == 2000 + len(licenses.words_of(notice))
    assert licenses.scan_documents(docs.limit(0)).count() == 0


def test_every_place(spark):
    scanner = licenses.Scanner(licenses.TEMPLATES)
    for name, t in licenses.TEMPLATES.items():
        for before in range(0, 90, 7):
            found = dict((n, s) for n, s, _, _ in scanner.scan("w " * before + t + " x" * (90 - before)))
            assert found.get(name) == 1


def test_common_licenses_are_found():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    found = lambda t: {name for name, *_ in scanner.scan("some words before it " * 30 + t + " and some words after it" * 30)}
    assert found("Licensed under the MIT license.") == {"MIT-short"}
    assert found("This work is licensed under a Creative Commons Attribution 4.0 International License.") == {"CC-BY-4.0-notice"}
    for name in ("GPL-2.0-text", "LGPL-2.1-text", "MPL-2.0-text", "BSD-disclaimer", "ISC-notice", "AGPL-3.0-notice", "MIT-warranty", "Unlicense-notice"):
        assert name in found(licenses.TEMPLATES[name])


def test_short_templates_are_found():
    scanner = licenses.Scanner({"two": "MIT License", "one": "GPL", "none": "...", "long": "released under the terms of this license"})
    assert scanner.scan("The MIT License applies. The MIT license.") == [("two", 1.0, 1, 3)]
    assert scanner.scan("gpl") == [("one", 1.0, 0, 1)] and scanner.scan("") == [] and scanner.scan(None) == []


def test_bands_alone_find_what_is_there(spark):
    """Without the gate that skips texts: the same rows, and the bands' recall of all that is contained to 0.8."""
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + list(licenses.TEMPLATES.values())
    words = licenses.TEMPLATES["GPL-3.0-notice"].split()
    texts += [" ".join(words[i:] + ["filler"] * i) for i in range(8)]
    gated, bare = licenses.Scanner(licenses.TEMPLATES), licenses.Scanner(licenses.TEMPLATES, gate=False)
    got = [bare.scan(t) for t in texts]
    assert got == [gated.scan(t) for t in texts]
    want = {(i, name) for i, t in enumerate(texts) for name, share in brute(t).items() if share >= 0.8}
    found = {(i, name) for i, rows in enumerate(got) for name, *_ in rows}
    assert found <= want and len(found) >= 0.999 * len(want) and len(want) > 40
